"""Operators 1 and 3 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import vectors


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, v array<double>, label int")


def made(n=400, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    rows = [(i, (base[i % len(base)] + rng.normal(scale=0.12, size=dim) * (i % 3)).tolist(), i % 5) for i in range(n)]
    rows += [(n, None, 0), (n + 1, [1.0, None] + [0.0] * (dim - 2), 0), (n + 2, [float("nan")] * dim, 1), (n + 3, [0.0] * dim, 1), (n + 4, [0.0] * dim, 2), (n + 5, [float("inf")] + [0.0] * (dim - 1), 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.1], 1), (n + 8, [], 1)]
    return rows + [(n + 50, rows[8][1], 9), (n + 51, rows[8][1], 9)]


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("chunk, block", [(32768, 2048), (7, 30)])
def test_top_k(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(vectors, "QUERIES", chunk)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = made()
    # repeated rows, one vec_id with several vectors, a query too, and components beyond 2**53
    rows += [rows[50], rows[50], (50, rows[7][1], 1), (3, rows[9][1], 1), (3, rows[9][1], 1), (700, [1e300] + [0.0] * 23, 1), (750, [3e14] * 24, 1), (701, [-3e14] * 23 + [5.0], 1), (None, rows[8][1], 1)]
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if fine(v) and i is not None]
    t = table(spark, rows).where(vectors.usable()).withColumn("raw", F.lit("clash"))
    t = t.withColumn("v", F.expr("transform(v, x -> rint(256 * x) - if(rint(256 * x) > 256 * x, 1.0D, 0.0D))"))
    got = {}
    for r in vectors.top_k(t, t.where("vec_id % 50 = 0 or vec_id >= 406"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ends = lambda n: max(1 - 2**63, min(2**63 - 1, n))
    asked = {i for i, _ in whole if i % 50 == 0 or i >= 406}
    assert set(got) <= asked
    for q in asked:
        scores = [(-ends(sum(a * b for a, b in zip(mine, x))), i) for one, mine in whole if one == q for i, x in whole if i != q and len(x) == len(mine)]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:5])]


def test_top_k_equals_sql_on_repeated_ids(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(2)
    rows = [(i % 60, rng.normal(size=8).tolist(), 0) for i in range(200)] + [(50, None, 1), (51, [float("inf")] * 8, 1)]
    rows += rows[:20]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"select query_id, rank, vec_id, score from ({vectors.ORACLE_TOP_K})").fetchall()
    assert sorted(map(tuple, vectors.op1_topk(spark, str(tmp_path)).collect())) == sorted(want)


def test_near_duplicates_equal_sql_on_repeated_ids(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 16))
    rows = [(i % 20, (base[i % 6] + rng.normal(scale=0.01, size=16)).tolist(), 0) for i in range(40)]
    rows += [rows[3], rows[3], (3, None, 0), (None, rows[5][1], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"select vec_id, n_links, component_id, kept from ({vectors.ORACLE_NEAR})").fetchall()
    assert sorted(map(tuple, vectors.op3_neardup(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = np.floor(rng.normal(size=(50, 64)) * 256), np.floor(rng.normal(size=(9, 64)) * 256)
    ones = np.ones(50, np.int64)
    best = vectors.Best(np.arange(9), q, ones[:9], np.full(9, -np.inf), 5)
    box = vectors.Boxes([(3, 64, *(f([np.concatenate([vectors.summaries(v[None], s)[0] for s in vectors.SEGMENTS]) for v in x]).tobytes() for f in (lambda s: np.min(s, 0), lambda s: np.max(s, 0))))])
    for level, segments in enumerate(vectors.SEGMENTS):
        bound = best.above(best._sums(x, segments), level, np.arange(9))
        assert (bound >= q @ x.T).all()
        assert (box.bounds(64, q)[1][:, 0] >= bound.max(1) - 1).all()


def test_survivors_only(monkeypatch):
    """Where few pairs survive the bounds, only these are computed, and blocks out of reach see no query."""
    rng = np.random.default_rng(3)
    x = np.floor(np.repeat(rng.normal(size=(400, 4)), 16, axis=1) * 256)
    best = vectors.Best(np.arange(20), x[:20], np.ones(20, np.int64), np.full(20, -np.inf), 5)
    pairs = []
    whole = np.einsum
    monkeypatch.setattr(vectors.np, "einsum", lambda form, a, b: pairs.append(len(a)) or whole(form, a, b))
    for at in range(0, 400, 100):
        best.add(np.arange(at, at + 100), x[at : at + 100], np.ones(100, np.int64))
    assert pairs and max(pairs) <= 0.15 * 20 * 100
    for i in range(20):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(400) if j != i)[:5]
        assert list(zip((-best.scores[i]).tolist(), best.found[i].tolist())) == want


def test_ties_go_to_smaller_ids(spark):
    t = spark.createDataFrame([(i, [1, 1]) for i in (9, 3, 7, 1, 5, 2, 50)], "vec_id long, v array<long>")
    got = vectors.top_k(t, t.where("vec_id = 50"), 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3]


@pytest.mark.parametrize("cell", [2048, 3])
def test_near_duplicates(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    rows = made() + [(None, made()[8][1], 0)]
    got = vectors.near_duplicates(table(spark, rows).drop("label").withColumn("class", F.lit(1)).drop("class")).collect()
    assert len(got) == len(rows)
    use = [(i, np.array(v)) if fine(v) and any(v) else (i, None) for i, v, _ in rows]
    links, group = [0] * len(use), list(range(len(use)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, (_, x) in enumerate(use):
        for b, (_, y) in enumerate(use[:a]):
            if x is not None and y is not None and len(x) == len(y) and x @ y >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y):
                links[a] += 1
                links[b] += 1
                group[max(root(a), root(b))] = min(root(a), root(b))
    found, over = 0, 0
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for k, (i, _) in enumerate(use):
        r = by[i][0]
        assert r.n_links <= links[k]
        found += r.n_links
        ids = [use[j][0] for j in range(len(use)) if root(j) == root(k) and use[j][0] is not None]
        over += r.component_id == min(ids)
        assert r.kept == (r.vec_id == r.component_id)
    assert found >= 0.97 * sum(links) and over >= 0.97 * len(use)


@pytest.mark.parametrize("n", [1000, 50_000, 1_000_000, 10**9])
def test_chance_to_miss_a_pair(n):
    bits, tables = vectors.plan_of(n)
    for cosine, most in ((0.9, 0.004), (0.92, 0.0011)):
        assert (1 - (1 - np.arccos(cosine) / np.pi) ** bits) ** tables <= most


def test_empty(spark):
    assert vectors.near_duplicates(table(spark, []).drop("label")).count() == 0
    alone = vectors.near_duplicates(table(spark, [(4, [1.0, 2.0], 0), (None, None, 0)])).orderBy("vec_id").collect()
    assert [tuple(r) for r in alone] == [(None, 0, None, True), (4, 0, 4, True)]
    t = spark.createDataFrame([], "vec_id long, v array<long>")
    assert vectors.top_k(t, t, 5).count() == 0
    one = spark.createDataFrame([(50, [1, 2])], "vec_id long, v array<long>")
    assert vectors.top_k(one, one, 5).count() == 0
