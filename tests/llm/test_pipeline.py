"""The pipeline's stages on a small corpus, each against what its operator has to do."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import queries, toxicity
from threadloom.llm.common import written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    docs = written(docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(900000, None, None, None, None)], docs.schema)))
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.count(), docs.columns
        docs = written(stage(spark, docs, SF))
        ids.append({r.doc_id for r in docs.select("doc_id").distinct().collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if "Jaccard" in name:
            assert docs.count() == docs.select("doc_id").distinct().count() < before
        if name == "PII":
            assert docs.count() == before and docs.where("text rlike '@mail[0-9]+.example'").count() == 0
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("which", ["empty", "odd"])
def test_stages_on_odd_tables(spark, which):
    """An empty table gives empty ones; nulls in any column, blank and long texts, repeats and a clashing column pass through."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string"
    rows = [(None, None, None, None, None, None), (1, "", "en", "a", 0, "x"), (2, " \t", None, "a", 2, None), (3, "some words that are here to stay", "en", None, 32, "x"), (4, "word " * 30_000, "de", "b", 150_000, "x")]
    rows += [rows[3], rows[3], (None, "no id at all but words", "en", "a", 22, "y")]
    docs = spark.createDataFrame(rows if which == "odd" else [], schema)
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.count(), docs.columns
        docs = written(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if "toxicity" in name or name == "PII":
            assert docs.count() == before
        if "Jaccard" in name:
            assert docs.count() == (0 if which == "empty" else 6)
        if "mixing" in name:
            assert docs.where("text is null or trim(text) = ''").count() == 0
    assert (docs.count() == 0) == (which == "empty")


def test_clean_learns_from_every_label(spark, tmp_path):
    """What only the last of 5,000 toxic documents have, by hash, goes too."""
    ids = [r.id for r in spark.range(20_000).where(~toxicity.held_out("id")).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, f"plain words{i % 50} here{i % 7}" + (" vilexx" if k < 12_300 else " groszzq") * (k % 3 == 0), "en", "s", 0) for k, i in enumerate(ids)]
    spark.createDataFrame([(i, 0, int(k % 3 == 0)) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.clean(spark, docs, str(tmp_path))
    assert left.where("text rlike 'vilexx|groszzq'").count() == 0 and left.count() == sum(k % 3 > 0 for k in range(len(ids)))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [x[columns].astype(str).sort_values(columns).values.tolist() for x in (got, want)]
    assert rows[0] == rows[1]
