"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import shared_folder
from ..shipping import ship

#: A word, as every contract of this package defines it.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing reads it any more."""
    path = getattr(df, "_loom_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - that session has ended; its folder's owner removes what is left
            continue


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of x over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, one after another, and the offsets of its rows (nulls are empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(offsets: np.ndarray, most: int):
    """Runs of rows of about `most` bytes, at least one row each: (first row, row after the last)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores where df has such columns."""
    out = []
    for name in names:
        while name in df.columns:
            name += "_"
        out.append(name)
    return out


def bits_for(n: float, least: int, most: int) -> int:
    """The bits of a table with n places or more, between two bounds."""
    return min(most, max(least, int(n).bit_length()))


def size_of(docs: DataFrame) -> int:
    """About how many bytes docs(text) has: what the planner knows of its files, or else the sum of the texts' lengths."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


BLOOM_BITS = 24
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rot(x, r: int):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _end(h):
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


def xx_long(keys: np.ndarray, seed: int) -> np.ndarray:
    """What Spark's xxhash64(int seed, long key) gives, for an array of keys."""
    with np.errstate(over="ignore"):
        h = np.uint64(42) + _P[4] + np.uint64(4)
        h ^= np.uint64(seed) * _P[0]
        h = _end(_rot(h, 23) * _P[1] + _P[2])
        h = np.full(len(keys), h + _P[4] + np.uint64(8), np.uint64)
        h ^= _rot(keys.astype(np.int64).view(np.uint64) * _P[1], 31) * _P[0]
        return _end(_rot(h, 27) * _P[0] + _P[3]).view(np.int64)


def bloom(keys: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of fixed size, with three probes, over the long column `key`; only its words come to the driver."""
    probes = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(s), "key"), F.lit(1 << bits)) for s in range(3)]))
    words = keys.select(probes.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = words.toPandas()
    out[got["w"].to_numpy()] = got["v"].to_numpy()
    return out


def in_bloom(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    hit = np.ones(len(keys), bool)
    for s in range(3):
        p = xx_long(keys, s) % (len(words) * 64)
        hit &= (words[p >> 6] >> (p & 63)) & 1 == 1
    return hit


def numbered(df: DataFrame, n: str, to: str) -> DataFrame:
    """Each row as often as its column n says, numbered from 0, in steps that keep every array short."""
    step = 4096
    df = df.withColumn(to, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / step) - 1)))
    return df.withColumn(to, F.explode(F.sequence(F.col(to) * step, F.least(F.col(n), (F.col(to) + 1) * step) - 1)))


def in_units(pairs: DataFrame, cell: int, most_bytes: int) -> DataFrame:
    """Where pairs (a, b, wa, wb: the bytes of either side) are verified: rows (unit, a, b).

    Pairs meet at a hub, the least partner of their `a` or itself, so a thing isn't sent once a pair. A hub of more than about `cell`
    pairs or `most_bytes` of members is split into a grid, so no unit holds an unbounded group.
    """
    near = pairs.selectExpr("a as x", "b as y").unionByName(pairs.selectExpr("b as x", "a as y")).groupBy("x").agg(F.min("y").alias("y"))
    hubs = near.select(F.col("x").alias("a"), F.least("x", "y").alias("hub"))
    at = written(pairs.join(hubs, "a"), "hubs")
    members = at.selectExpr("hub", "a as x", "wa as w").unionByName(at.selectExpr("hub", "b as x", "wb as w")).distinct()
    size = members.groupBy("hub").agg(F.sum("w").alias("w"))
    count = at.groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    grid = count.join(size, "hub").select("hub", F.greatest(F.ceil(F.sqrt(F.col("m") / cell)), F.ceil(2 * F.col("w") / most_bytes)).cast("int").alias("g"))
    at = at.join(grid.where("g > 1"), "hub", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    return at.withColumn("unit", F.xxhash64("hub", F.pmod(F.hash("a"), "g"), F.pmod(F.hash("b"), "g"))).select("unit", "a", "b")


def lean(run):
    """run, a function of mapInArrow, giving the memory it has freed back to the system at its end: workers live on.

    The package goes to the workers first, as run names functions of it.
    """
    ship()

    def go(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return go


def trim() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def _forest(batches):
    """Union-find over the edges of one partition; yields a spanning forest as (node, root)."""
    import pyarrow as pa

    up: dict = {}

    def find(x):
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        some = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a long, b long): rows (node, root) of every node with an edge; root is the least node reachable.

    Each partition first reduces its edges to a forest, so that a node of any degree leaves at most one row a partition.
    Then, until nothing changes, nodes take the least label among their neighbours, hand it to the node that was
    their label (so whole trees hook to one another, and rounds grow with the logarithm of a chain's length) and jump to
    their label's label; every round is written to the shared folder. Labels only fall, and where they are at rest
    both ends of every edge have the same one. Nulls have no edges. No edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b")
    edges = written(edges.mapInArrow(lean(_forest), "a long, b long"), "forest")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    moved = True
    while moved:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        seen = written(labels.join(near, "node").select("node", F.least("root", "seen").alias("one"), "root"), "seen")
        handed = seen.groupBy(F.col("root").alias("node")).agg(F.min("one").alias("handed"))
        two = seen.join(handed, "node", "left").select("node", F.least("one", "handed").alias("two"), "root")
        up = labels.select(F.col("node").alias("two"), F.col("root").alias("jump"))
        new = two.join(up, "two", "left").select("node", F.least("two", "jump").alias("new"), "root")
        new = written(new.select("node", F.col("new").alias("root"), (F.col("new") != F.col("root")).alias("moved")), "labels")
        moved = not new.where("moved").isEmpty()
        forget(seen)
        forget(labels)
        labels = new
    forget(edges)
    return labels.select("node", "root")
