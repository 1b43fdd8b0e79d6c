"""Operators 1 and 3 over vectors: exact top-k search, and near-duplicates by cosine.

Top-k. Vectors are of whole numbers. Each is summed up by the mean and deviation of its segments, at two resolutions,
scaled so that their squares add up to the vector's own. They bound the distance from below,
|q - x|^2 >= sum over segments of length * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2), and so the inner product,
(|q|^2 + |x|^2 - |q - x|^2) / 2, from above, by the inner product of the summaries.

1. Candidates are range-sorted by size and coarse means into blocks; a block's box holds its summaries.
2. Every query is compared with the block whose box promises most. Its k-th best score there is its threshold.
3. Only the blocks whose boxes reach a query's threshold see that query. There, what the coarse and then the fine bound
   leave above the threshold is computed exactly; pair by pair where few are left, else as a product of matrices.

Scores are whole: pairs whose inner product may reach 2**53 are computed with integers of any size (and what a long
can't hold is its nearest end).

Near-duplicates. Equal vectors are one class first. Signs of random hyperplanes give each class a bucket in several
tables; the number of bits grows with the number of vectors, and of tables with the bits, so that a pair at the
threshold is missed with probability MISS at most. Only ids and signs are shuffled for that. A bucket of more than
CELL vectors is split into a grid of cells, so all its pairs are compared, no more than two cells at a time: a pair whose
signs differ in few enough places is a candidate, emitted in the first table that it shares. Candidates' vectors then
meet in units of bounded size, where cosines are computed in doubles. Connected components are distributed.

Cases: vectors that are null or hold null or non-finite components take no part (nor, for cosine, do zero ones):
in top-k they have no rows, among near-duplicates they are their own component without links. Only vectors of one
length meet. Rows with a null vec_id are neither queries nor candidates; among near-duplicates they count as links.
Repeated rows are candidates one by one, but never for a query of their own vec_id; query rows of one vec_id are one
query with the best of all their scores. Empty tables give empty tables; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, forget, in_units, lean, written

#: Queries of a unit; vectors of a block, blocks at most (so that their boxes may be broadcast), and numbers of a tile.
QUERIES, BLOCK, BLOCKS, TILE = 32768, 2048, 4096, 4_000_000
#: Below this share of a tile, survivors are computed pair by pair.
SPARSE = 0.15
SEGMENTS = (4, 16)
THRESHOLD = 0.9
#: Vectors a bucket holds on average, vectors a cell of a split bucket holds at most, about, and the chance of a miss.
BUCKET, CELL, MISS = 200, 2048, 0.004
#: Signs that candidates are compared by at most, and the share of MISS for pairs whose signs differ in too many places.
SIGNS, TAIL = 256, 0.0001
#: Pairs, and bytes of vectors, that one unit verifies, about.
UNIT, UNIT_BYTES = 50_000, 32_000_000
SEED = 20_24


def usable(vector: str = "v"):
    return F.expr(f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def summaries(x: np.ndarray, segments: int) -> np.ndarray:
    """Per vector: means and deviations of its segments, each times the root of the segment's length."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    out = [np.sqrt(len(p)) * x[:, p].mean(1) for p in parts] + [np.sqrt(len(p)) * x[:, p].std(1) for p in parts]
    return np.stack(out, axis=1)


def _matrix(column, dim: int, kind=np.float64) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, dim)


def _by_dim(column):
    """(length, places, matrix) for each length of an Arrow column of lists."""
    import pyarrow as pa

    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False))
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, _matrix(column.take(pa.array(at)), dim)


def whole_bytes(x: np.ndarray) -> list[bytes]:
    """Vectors of whole numbers in as many bytes a component as they need: 2, 4 or 8."""
    top = np.abs(x).max(1)
    kinds = np.where(top < 2**15, 0, np.where(top < 2**31, 1, 2)).tolist()
    forms = (x.astype("<i2") if 0 in kinds else x, x.astype("<i4") if 1 in kinds else x, x.astype("<f8"))
    return [b"248"[k : k + 1] + forms[k][i].tobytes() for i, k in enumerate(kinds)]


def from_whole_bytes(raws: list[bytes]) -> np.ndarray:
    form = {b"2": "<i2", b"4": "<i4", b"8": "<f8"}
    kinds = {raw[:1] for raw in raws}
    if len(kinds) == 1:
        return np.frombuffer(b"".join(raw[1:] for raw in raws), form[kinds.pop()]).reshape(len(raws), -1).astype(np.float64)
    return np.stack([np.frombuffer(raw[1:], form[raw[:1]]).astype(np.float64) for raw in raws])


def sort_key(x: np.ndarray) -> np.ndarray:
    """A number that puts vectors of like size and coarse means side by side."""
    coarse = summaries(x / np.maximum(np.abs(x).max(1, keepdims=True), 1), SEGMENTS[0])
    coarse = coarse[:, : coarse.shape[1] // 2] / np.maximum(np.sqrt((coarse**2).sum(1, keepdims=True)), 1e-300)
    cell = np.clip(((coarse + 1) * 8).astype(np.int64), 0, 15)
    key = (np.frexp(np.abs(x).max(1))[1].astype(np.int64) + 2048) << 16
    for bit in range(4):
        for i in range(cell.shape[1]):
            key |= ((cell[:, i] >> bit) & 1) << (bit * cell.shape[1] + i)
    return key


class Boxes:
    """For each length of vectors: the blocks, and the least and greatest summaries in them, by level."""

    def __init__(self, rows: list[tuple]):
        self.of: dict = {}
        for block, dim, lo, hi in rows:
            mine = self.of.setdefault(dim, {})
            lo, hi = np.frombuffer(lo), np.frombuffer(hi)
            if block in mine:
                lo, hi = np.minimum(lo, mine[block][0]), np.maximum(hi, mine[block][1])
            mine[block] = lo, hi
        for dim, mine in self.of.items():
            cut = 2 * min(SEGMENTS[0], dim)
            lo, hi = (np.stack([x[i] for x in mine.values()]) for i in (0, 1))
            self.of[dim] = np.array(list(mine)), [(lo[:, :cut], hi[:, :cut]), (lo[:, cut:], hi[:, cut:])]

    def bounds(self, dim: int, x: np.ndarray):
        """The blocks for vectors of this length, and what no inner product of x with a vector there exceeds."""
        blocks, levels = self.of[dim]
        out = np.inf
        with np.errstate(over="ignore", invalid="ignore"):
            for segments, (lo, hi) in zip(SEGMENTS, levels):
                q = summaries(x, segments)
                up, down = np.maximum(q, 0), np.minimum(q, 0)
                slack = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T
                out = np.minimum(out, up @ hi.T + down @ lo.T + 1e-9 * slack + 1e-6)
        return blocks, out


_NONE = np.iinfo(np.int64).min


class Best:
    """The k best (score, id) of each query above its floor, ties to the smaller id; `times` counts equal pairs."""

    def __init__(self, ids, x, times, floor, k: int):
        self.ids, self.x, self.times, self.floor, self.k = ids, x, times, floor, k
        self.sums = [self._sums(x, s) for s in SEGMENTS]
        self.top = np.abs(x).max(1)
        n = len(ids)
        self.scores, self.found, self.count = np.full((n, k), _NONE), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    @staticmethod
    def _sums(x, segments):
        with np.errstate(over="ignore", invalid="ignore"):
            s = summaries(x, segments)
            return np.concatenate((s, np.sqrt((s**2).sum(1, keepdims=True))), axis=1)

    def above(self, sums, level: int, rows) -> np.ndarray:
        """An upper bound of the inner products; the last column of the summaries, the norm, allows for rounding."""
        q = self.sums[level][rows].copy()
        q[:, -1] *= 1e-9
        with np.errstate(over="ignore", invalid="ignore"):
            return q @ sums.T + 1e-6

    def least(self) -> np.ndarray:
        """What a score has to reach."""
        worst = self.scores[:, -1].astype(np.float64)
        worst = np.where(np.abs(worst) >= 2.0**53, np.nextafter(worst, -np.inf), worst)
        return np.maximum(self.floor, np.where(self.count[:, -1] > 0, worst, -np.inf))

    def add(self, ids, x, times) -> None:
        step = max(16, TILE // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            self._tile(ids[at : at + step], x[at : at + step], times[at : at + step])

    def _tile(self, ids, x, times) -> None:
        rows, cols, least = np.arange(len(self.ids)), np.arange(len(ids)), self.least()
        alive = self.ids[:, None] != ids[None]
        for level, segments in enumerate(SEGMENTS):
            alive &= ~(self.above(self._sums(x[cols], segments), level, rows) < least[rows][:, None])
            r, c = alive.any(1), alive.any(0)
            rows, cols, alive = rows[r], cols[c], alive[np.ix_(r, c)]
            if not len(rows):
                return
        large = self.top[rows][:, None] * np.abs(x[cols]).max(1)[None] * x.shape[1] >= 2.0**53
        large &= alive
        i, j = np.nonzero(large)
        if len(i):
            alive &= ~large
            self._merge(rows[i], self._exact(rows[i], x[cols[j]]), ids[cols[j]], times[cols[j]])
        if alive.mean() < SPARSE:
            i, j = np.nonzero(alive)
            s = np.einsum("ij,ij->i", self.x[rows[i]], x[cols[j]])
            hit = s >= least[rows[i]]
            i, j, s = i[hit], j[hit], s[hit]
        else:
            s = self.x[rows] @ x[cols].T
            alive &= s >= least[rows][:, None]
            if alive.sum() > 4 * self.k * len(rows) and s.shape[1] > self.k:
                s[~alive] = -np.inf
                alive &= s >= np.partition(s, -self.k, axis=1)[:, -self.k][:, None]
            i, j = np.nonzero(alive)
            s = s[i, j]
        self._merge(rows[i], s.astype(np.int64), ids[cols[j]], times[cols[j]])

    def _exact(self, rows, x) -> np.ndarray:
        whole = np.frompyfunc(int, 1, 1)
        ends = np.iinfo(np.int64)
        return np.array([min(max(int((whole(self.x[r]) * whole(v)).sum()), ends.min + 1), ends.max) for r, v in zip(rows.tolist(), x)], np.int64)

    def _merge(self, rows, scores, ids, times) -> None:
        if not len(rows):
            return
        who = np.unique(rows)
        old = np.nonzero(self.count[who] > 0)
        r = np.concatenate((who[old[0]], rows))
        s, d, t = (np.concatenate((held[who][old], new)) for held, new in ((self.scores, scores), (self.found, ids), (self.count, times)))
        order = np.lexsort((d, ~s, r))
        r, s, d, t = r[order], s[order], d[order], t[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < self.k
        r, s, d, t, place = r[keep], s[keep], d[keep], t[keep], place[keep]
        self.count[who] = 0
        self.scores[r, place], self.found[r, place], self.count[r, place] = s, d, t


_ITEM = "vec_id long, dim int, key long, raw binary"


def _items(batches):
    """Rows (vec_id, dim, key, raw) of vectors of whole numbers."""
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0).to_numpy()
        for dim, at, x in _by_dim(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), dim, np.int32)), pa.array(sort_key(x)), pa.array(whole_bytes(x), pa.binary())], ["vec_id", "dim", "key", "raw"])


def _boxes(batches):
    """Rows (block, dim, lo, hi): the boxes of the batches' blocks."""
    import pyarrow as pa

    held: dict = {}
    for batch in batches:
        block, dim = (batch.column(i).to_numpy() for i in (0, 1))
        pair = block.astype(np.int64) << 32 | dim
        for p in np.unique(pair).tolist():
            at = np.flatnonzero(pair == p)
            x = from_whole_bytes(batch.column(2).take(pa.array(at)).to_pylist())
            with np.errstate(over="ignore", invalid="ignore"):
                s = np.nan_to_num(np.concatenate([summaries(x, n) for n in SEGMENTS], axis=1), nan=np.inf)
            lo, hi = s.min(0), s.max(0)
            if p in held:
                lo, hi = np.minimum(lo, held[p][0]), np.maximum(hi, held[p][1])
            held[p] = lo, hi
    if held:
        columns = [p >> 32 for p in held], [p & 0xFFFFFFFF for p in held], [x.tobytes() for x, _ in held.values()], [x.tobytes() for _, x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["block", "dim", "lo", "hi"])


_ROUTED = "block int, vec_id long, dim int, raw binary, n long, least double"


def _routed(queries: DataFrame, boxes, further: bool) -> DataFrame:
    """queries(block, vec_id, dim, raw, n, least), each to the most promising block, or to all other ones that can reach its threshold."""

    def run(batches):
        import pyarrow as pa

        names = ["block", "vec_id", "dim", "raw", "n", "least"]
        for batch in batches:
            dims, seen = batch.column(2).to_numpy(), batch.column(0)
            for dim in np.unique(dims).tolist():
                if dim not in boxes.value.of:
                    continue
                every = np.flatnonzero(dims == dim)
                for at in range(0, len(every), 512):
                    part = batch.take(pa.array(every[at : at + 512]))
                    blocks, bound = boxes.value.bounds(dim, from_whole_bytes(part.column(3).to_pylist()))
                    if further:
                        to = ~(bound < part.column(5).to_numpy()[:, None]) & (blocks[None] != part.column(0).to_numpy()[:, None])
                        i, j = np.nonzero(to)
                    else:
                        i, j = np.arange(len(bound)), np.nan_to_num(bound, nan=np.inf).argmax(1)
                    for a in range(0, len(i), 20_000):
                        some = part.take(pa.array(i[a : a + 20_000]))
                        yield pa.RecordBatch.from_arrays([pa.array(blocks[j[a : a + 20_000]], pa.int32()), *some.columns[1:]], names)

    return queries.mapInArrow(lean(run), _ROUTED)


def _searched(routed: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """What queries find in the blocks they are routed to: rows (query_id, vec_id, score, times), and for each query row (block, vec_id, dim, raw, n, least)."""
    spark = routed.sparkSession
    counts = routed.groupBy("block").count().collect()
    parts = spark.createDataFrame([(r.block, -(-r["count"] // QUERIES)) for r in counts], "block int, parts long")
    columns = ["block", "part", "dim", "kind", "vec_id", "raw", "n", "least"]
    q = routed.join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64("vec_id", "raw"), "parts")).withColumn("kind", F.lit(0)).select(*columns)
    c = blocks.join(F.broadcast(parts), "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    c = c.withColumn("kind", F.lit(1)).withColumn("least", F.lit(0.0)).select(*columns)
    names = ["query_id", "vec_id", "score", "times", "block", "dim", "raw", "n", "least"]
    kinds = "query_id long, vec_id long, score long, times long, block int, dim int, raw binary, n long, least double"

    def run(batches):
        import pyarrow as pa

        now, waiting, best, raws = None, [], None, []

        def out():
            i, j = np.nonzero(best.count > 0)
            times = np.minimum(best.times[i], k) * np.minimum(best.count[i, j], k)
            m, least = len(i), best.least()
            found = [pa.array(best.ids[i]), pa.array(best.found[i, j]), pa.array(best.scores[i, j]), pa.array(np.minimum(times, k))]
            yield pa.RecordBatch.from_arrays([*found, pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64())], names)
            n = len(raws)
            rest = [pa.array(np.full(n, now[0], np.int32)), pa.array(np.full(n, now[2], np.int32)), pa.array(raws, pa.binary()), pa.array(best.times), pa.array(least)]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(best.ids), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *rest], names)

        def begun():
            nonlocal raws
            raws = [r for w in waiting for r in w[1]]
            return Best(*(np.concatenate([w[i] for w in waiting]) if i != 1 else from_whole_bytes(raws) for i in range(4)), k)

        for batch in batches:
            key = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            kind = batch.column(3).to_pylist()
            cut = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1] or kind[i] != kind[i - 1]), len(key)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                if key[a] != now:
                    if best is None and waiting:
                        best = begun()
                    if best is not None:
                        yield from out()
                    now, waiting, best = key[a], [], None
                part = batch.slice(a, b - a)
                ids, raw, n, least = part.column(4).to_numpy(), part.column(5).to_pylist(), part.column(6).to_numpy(), part.column(7).to_numpy()
                if kind[a] == 0:
                    waiting.append((ids, raw, n, least))
                    continue
                if best is None and waiting:
                    best = begun()
                if best is not None:
                    best.add(ids, from_whole_bytes(raw), n)
        if best is None and waiting:
            best = begun()
        if best is not None:
            yield from out()

    return q.unionByName(c).repartition("block", "part").sortWithinPartitions("block", "part", "dim", "kind").mapInArrow(lean(run), kinds)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) from vectors(vec_id, v: array of whole numbers) and queries(vec_id, v)."""
    spark = vectors.sparkSession
    ready = lambda df: df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).where(usable())
    # equal rows are one item with their number
    items = lambda df: ready(df).mapInArrow(lean(_items), _ITEM).groupBy("vec_id", "dim", "key", "raw").agg(F.count(F.lit(1)).alias("n"))
    every, asked = written(items(vectors), "items"), written(items(queries).drop("key"), "queries")
    n = every.count()
    across = min(BLOCKS, max(1, -(-n // min(65536, max(BLOCK, n // 64)))))
    order = ["dim", "key", "vec_id", F.xxhash64("raw")]
    blocks = written(every.repartitionByRange(across, *order).select(F.spark_partition_id().alias("block"), "vec_id", "dim", "raw", "n"), "blocks")
    boxes = spark.sparkContext.broadcast(Boxes([tuple(r) for r in blocks.select("block", "dim", "raw").mapInArrow(lean(_boxes), "block int, dim int, lo binary, hi binary").collect()]))
    asked = asked.select(F.lit(-1).alias("block"), "vec_id", "dim", "raw", "n", F.lit(float("-inf")).alias("least"))
    first = written(_searched(written(_routed(asked, boxes, False), "first"), blocks, k), "found")
    rest = written(_routed(first.where("raw is not null").select("block", "vec_id", "dim", "raw", "n", "least"), boxes, True), "rest")
    found = first.unionByName(_searched(rest, blocks, k)).where("raw is null").select("query_id", "vec_id", "score", "times")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    # rint stays a double, so a component of any size keeps its value
    rows = rows.where(usable()).select("vec_id", F.expr("transform(v, x -> rint(256 * x) - if(rint(256 * x) > 256 * x, 1.0D, 0.0D))").alias("v"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))


def plan_of(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits a table and tables for n vectors. (More than 40 bits pay from 10**14 vectors on.)"""
    bits = min(40, max(6, round(math.log2(max(1, n) / BUCKET))))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss - TAIL) / math.log(1 - hit))


def most_apart(signs: int, threshold: float = THRESHOLD, tail: float = TAIL) -> int:
    """In how many of so many signs a pair at the threshold differs at most, but for a chance of `tail`."""
    p, below = math.acos(threshold) / math.pi, 0.0
    for c in range(signs):
        below += math.comb(signs, c) * p**c * (1 - p) ** (signs - c)
        if below >= 1 - tail:
            return c
    return signs


def _packed(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes, scaled by a power of two: in four bytes a component where that loses nothing, else in eight."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    small = (x.astype(np.float32) == x).all(1)
    return [b"4" + r.astype("<f4").tobytes() if s else b"8" + r.astype("<f8").tobytes() for r, s in zip(x, small.tolist())]


def _unpacked(raws: list[bytes]) -> np.ndarray:
    """The vectors in doubles, of length 1."""
    kinds = {raw[:1] for raw in raws}
    if len(kinds) == 1:
        x = np.frombuffer(b"".join(raw[1:] for raw in raws), "<f4" if kinds == {b"4"} else "<f8").reshape(len(raws), -1).astype(np.float64)
    else:
        x = np.stack([np.frombuffer(raw[1:], "<f" + raw[:1].decode()).astype(np.float64) for raw in raws])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def candidates(vectors: DataFrame, n: int, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """Pairs (a, b, dim) of ids, a < b, each once, that share a bucket and differ in few signs, from n vectors(id long, v array<double>)."""
    bits, tables = plan_of(n, threshold, miss)
    signs = min(SIGNS, bits * tables)
    apart = most_apart(signs, threshold)

    def sign(batches):
        import pyarrow as pa

        planes: dict[int, np.ndarray] = {}
        names = ["dim", "t", "code", "id", "signs"]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for dim, at, x in _by_dim(batch.column(1)):
                x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
                if dim not in planes:
                    planes[dim] = np.random.default_rng(SEED + dim).normal(size=(dim, bits * tables))
                up = x @ planes[dim] > 0
                code = up.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                raw = pa.array([r.tobytes() for r in np.packbits(up, axis=1)], pa.binary())
                for t in range(tables):
                    fill = [pa.array(np.full(len(x), v, np.int32)) for v in (dim, t)]
                    yield pa.RecordBatch.from_arrays([*fill, pa.array(code[:, t]), pa.array(ids[at]), raw], names)

    bucket = ["dim", "t", "code"]
    rows = written(vectors.select("id", "v").mapInArrow(lean(sign), "dim int, t int, code long, id long, signs binary"), "signs")
    large = written(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CELL), "large")
    dealt = rows.join(large, bucket, "left").withColumn("g", F.coalesce(F.ceil(F.col("m") / CELL).cast("int"), F.lit(1)))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("id"), "g").cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select(*bucket, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.col("i").alias("mine"), "id", "signs")

    def compare(batches):
        import pyarrow as pa

        unit, held = None, []

        def pairs():
            if len(held) < 2:
                return
            ids, mine = np.array([h[1] for h in held]), np.array([h[0] for h in held])
            raw = np.frombuffer(b"".join(h[2] for h in held), np.uint8).reshape(len(held), -1)
            short = np.unpackbits(raw, axis=1, count=bits * tables)[:, :signs]
            short = np.packbits(np.pad(short, ((0, 0), (0, -signs % 64))), axis=1).view(np.uint64)
            left, right = (np.arange(len(ids)),) * 2 if unit[3] == unit[4] else (np.flatnonzero(mine == unit[3]), np.flatnonzero(mine == unit[4]))
            code = np.unpackbits(raw, axis=1, count=bits * tables).reshape(len(ids), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            for at in range(0, len(left), 512):
                some = left[at : at + 512]
                far = np.zeros((len(some), len(right)), np.uint16)
                for w in range(short.shape[1]):
                    far += np.bitwise_count(short[some, w][:, None] ^ short[right, w][None])
                a, b = np.nonzero(far <= apart)
                a, b = some[a], right[b]
                if unit[3] == unit[4]:
                    a, b = a[a < b], b[a < b]
                new = ~(code[a, : unit[1]] == code[b, : unit[1]]).any(1)
                a, b = ids[a[new]], ids[b[new]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), unit[0], np.int32))], ["a", "b", "dim"])

        for batch in batches:
            for u, row in zip(zip(*(batch.column(i).to_pylist() for i in range(5))), zip(*(batch.column(i).to_pylist() for i in range(5, 8)))):
                if u != unit:
                    yield from pairs()
                    unit, held = u, []
                held.append(row)
        yield from pairs()

    cell = [*bucket, "lo", "hi"]
    pairs = written(dealt.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(lean(compare), "a long, b long, dim int"), "pairs")
    forget(rows)
    return pairs


def near_pairs(vectors: DataFrame, n: int, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """Pairs (a, b) of ids, a < b, with a cosine of at least `threshold`, from n vectors(id long, v array<double>)."""
    pairs = candidates(vectors, n, threshold, miss)
    weight = (F.col("dim") * 8).cast("long")
    at = written(in_units(pairs.select("a", "b", weight.alias("wa"), weight.alias("wb")), UNIT, UNIT_BYTES), "units")
    wanted = at.select("unit", F.col("a").alias("id")).unionByName(at.select("unit", F.col("b").alias("id"))).distinct()

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for _, at, x in _by_dim(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(_packed(x), pa.binary())], ["id", "raw"])

    raws = vectors.select("id", "v").mapInArrow(lean(pack), "id long, raw binary")
    members = wanted.join(raws, "id").select("unit", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "raw")
    rows = members.unionByName(at.select("unit", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("raw")))

    def verify(batches):
        import pyarrow as pa

        unit, ids, raws, place, x = None, [], [], {}, None
        for batch in batches:
            units, kinds, a, b, raw = (batch.column(i).to_pylist() for i in range(5))
            cut = [0, *(i for i in range(1, len(units)) if units[i] != units[i - 1] or kinds[i] != kinds[i - 1]), len(units)]
            for s, e in zip(cut, cut[1:]):
                if s == e:
                    continue
                if units[s] != unit:
                    unit, ids, raws, x = units[s], [], [], None
                if kinds[s] == 0:
                    ids += a[s:e]
                    raws += raw[s:e]
                    continue
                if x is None:
                    x, place = _unpacked(raws), {i: k for k, i in enumerate(ids)}
                i, j = (np.array([place[v] for v in side[s:e]]) for side in (a, b))
                good = np.flatnonzero(np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 8192]], x[j[k : k + 8192]]) for k in range(0, e - s, 8192)]) >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(s, e - s).take(pa.array(good)) for c in (2, 3)], ["a", "b"])

    return rows.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(lean(verify), "a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """For vectors(vec_id, v array<double>): vec_id, n_links, component_id and kept of every row."""
    fine = usable() & F.expr("exists(v, x -> x <> 0)")
    rows = written(vectors.select("vec_id", F.when(fine, F.xxhash64("v")).alias("class"), F.when(fine, F.col("v")).alias("v")), "vectors")
    members = written(rows.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"), F.first("v").alias("v")), "classes")
    links = written(near_pairs(members.select(F.col("class").alias("id"), "v"), members.count(), threshold, miss), "links")
    members = members.drop("v")
    both = links.unionByName(links.selectExpr("b as a", "a as b"))
    others = both.join(members, both.b == members["class"]).groupBy("a").agg(F.sum("m").alias("others"))
    roots = components(links)
    found = members.join(roots, members["class"] == roots.node, "left").join(others, members["class"] == others.a, "left")
    found = written(found.select("class", "least", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root")), "found")
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    found = found.join(least, "root").select("class", "n_links", "component_id")
    out = rows.where("class is not null").join(found, "class").select("vec_id", "n_links", "component_id")
    alone = rows.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near_duplicates(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")))


ORACLE_TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_NEAR = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT * FROM w WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
n AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT r AS a, r AS b FROM w UNION SELECT c.a, n.b FROM c JOIN n ON c.b = n.a),
l AS (SELECT a, min(vec_id) AS component_id FROM c JOIN w ON c.b = w.r GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM n GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM w JOIN l ON w.r = l.a LEFT JOIN k ON w.r = k.a
"""
