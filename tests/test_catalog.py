"""Every catalogue query against its SQL, over the small driver tables."""

import os

import duckdb
import pytest

from threadloom.plans import catalog, workflow_catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


assert workflow_catalog.query is catalog.query


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [x[columns].astype(str).sort_values(columns).values.tolist() for x in (got, want)]
    assert rows[0] == rows[1]
