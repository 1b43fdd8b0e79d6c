"""Operator 6: n-gram Jaccard self-join.

Every document is the set of its distinct word n-grams, held as 64-bit fingerprints. Documents with equal sets are
one class; classes are joined by rare-first prefix filtering:

1. All documents' shingles are counted in a sketch that grows with the input up to SKETCH_BITS, each task counting its own and
   the counts being added up slice by slice; what is broadcast is their logarithms, a byte each. The order of shingles is
   (count, fingerprint): any order gives the exact result, and the count keeps passages that many documents share out of the prefixes.
2. Classes that share a shingle of their prefixes and pass the length and the positional filter are candidates,
   each pair once. A shingle in more than HOT prefixes is split into a grid of cells, so no task joins a whole hot group.
3. The sets of candidates, found again with a Bloom filter that grows with their number up to BLOOM_BITS, go to where their pairs are verified:
   pairs meet at a hub (the least candidate of their smaller member), and a hub with many pairs or large sets is split into a
   grid, so neither is a set sent once a pair nor does one task hold an unbounded group. The suffix filter bounds the
   symmetric difference from counts in ranges of fingerprints; what passes is intersected. Beyond the filter's bound more sets than
   needed travel, at most each once.

Cases: null and blank texts have no words, an empty set and no links, and are their own component; texts with fewer
words than n are one shingle; repeated rows are links of each other; null doc_ids take part, and a component's id
is the least doc_id that is not null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bits_for, bloom, components, forget, free, in_bloom, in_units, lean, mix64, pieces, size_of, text_bytes, written

N = 5
#: The threshold as a fraction of whole numbers, 90 / 100 of the union.
NUM, DEN = 9, 10
#: Bits of the sketch's and the filter's places at most: 64 MB and 32 MB are broadcast.
SKETCH_BITS, BLOOM_BITS = 26, 28
#: Bytes of input for each place of the sketch.
PLACE = 64
#: Bytes of text that are worked on at once.
BLOCK = 500_000
#: Pairs that one cell of a hub's grid verifies, about.
CELL = 20_000
#: Bytes of the sets that a cell holds, about (a set may be larger by itself).
CELL_BYTES = 64_000_000
#: Prefixes that one cell of a shingle's grid joins, about.
HOT = 1000
RANGES = 64
#: Bits of the filter that clears rows in `deduplicated` at most: 2**18 words of it, 4 MB, are broadcast.
DOUBT_BITS = 24

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_tables: dict = {}


def _table():
    """Codes of the bytes (A-Z as a-z), powers of an odd base and their inverses modulo 2**64."""
    if not _tables:
        codes = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
        codes[65:91] = codes[97:123]
        word = np.ones(256, bool)
        word[[0x20, *range(0x09, 0x0E)]] = False
        _tables.update(codes=codes, word=word, up=np.ones(1, _U), down=np.ones(1, _U))
    return _tables


def _powers(n: int):
    t = _table()
    if len(t["up"]) < n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", _U(inverse))):
            x = np.full(n, base, _U)
            x[0] = 1
            t[name] = np.multiply.accumulate(x)
    return t["codes"], t["word"], t["up"], t["down"]


def fingerprints(raw: np.ndarray, offsets: np.ndarray, n: int = N):
    """Yields (row, sorted distinct fingerprints of its shingles) for every row of text bytes."""
    for first, last in pieces(offsets, BLOCK):
        base = offsets[first]
        text, at = raw[base : offsets[last]], offsets[first : last + 1] - base
        size = len(text)
        codes, word, up, down = _powers(size + 1)
        is_word = word[text]
        edge = np.zeros(size + 1, bool)
        edge[at] = True
        before = np.zeros(size + 1, bool)
        before[1:] = is_word
        now = np.zeros(size + 1, bool)
        now[:size] = is_word
        starts = np.flatnonzero(now & (~before | edge))
        ends = np.flatnonzero(before & (~now | edge))
        total = np.zeros(size + 1, _U)
        np.cumsum(codes[text] * up[:size], out=total[1:])
        words = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _BASE)
        w_at = np.searchsorted(starts, at)
        m = len(words)
        mixed = words[: max(0, m - n + 1)].copy()
        for k in range(1, n):
            mixed *= _BASE
            mixed += words[k : m - n + 1 + k]
        mixed = mix64(mixed)
        for i in range(last - first):
            lo, hi = w_at[i], w_at[i + 1]
            if hi - lo >= n:
                got = np.sort(mixed[lo : hi - n + 1])
                if len(got) > 1:
                    got = got[np.concatenate(([True], got[1:] != got[:-1]))]
            elif hi > lo:
                one = _U(hi - lo)
                for x in words[lo:hi]:
                    one = mix64(np.array([one * _BASE + x], _U))[0]
                got = np.array([one], _U)
            else:
                got = np.zeros(0, _U)
            yield first + i, got


def class_of(got: np.ndarray) -> int:
    """A 64-bit id of a set, from the sum of its mixed fingerprints and its size."""
    with np.errstate(over="ignore"):
        x = mix64(np.array([mix64(got ^ _BASE).sum(dtype=_U) * _BASE + _U(len(got))], _U))
    return int(x.view(np.int64)[0])


def _sets(batches, column: int, n: int):
    with np.errstate(over="ignore"):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(column))
            yield batch, fingerprints(raw, offsets, n)


def classes_and_sketch(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """One pass over docs(doc_id, text): rows (doc_id, n_shingles, class), and rows (slice, counts) of the sketch."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        counts = np.zeros(1 << bits, np.uint32)
        held, waiting = [], 0
        names = ["doc_id", "n_shingles", "class", "slice", "counts"]

        def add():
            nonlocal held, waiting
            if held:
                np.add(counts, np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32), out=counts)
            held, waiting = [], 0

        for batch, sets in _sets(batches, 1, n):
            sizes, ids = [], []
            for _, got in sets:
                sizes.append(len(got))
                ids.append(class_of(got))
                held.append((got >> _U(64 - bits)).astype(np.int32))
                waiting += len(got)
                if waiting > 1_000_000:
                    add()
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        add()
        if counts.any():
            pack = zstandard.ZstdCompressor(level=1)
            parts = [pack.compress(x.tobytes()) for x in np.split(counts, 16)]
            yield pa.RecordBatch.from_arrays([pa.nulls(16, pa.int64()), pa.nulls(16, pa.int64()), pa.nulls(16, pa.int64()), pa.array(range(16), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, class long, slice int, counts binary")


def add_up(slices: DataFrame, bits: int) -> np.ndarray:
    """Logarithms of the sketch's counts, from every task's slices; what comes to the driver has a byte for each place."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_py()), np.uint32)
                if k in totals:
                    most = np.uint32(0xFFFFFFFF) - totals[k]
                    totals[k] += np.minimum(part, most)
                else:
                    totals[k] = part.copy()
        for k, x in totals.items():
            # eight steps an octave; whole numbers up to eight stay apart
            x = np.round(8 * np.log2(1.0 + x)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "counts"])

    out = np.zeros(1 << bits, np.uint8)
    size = len(out) // 16
    for row in slices.repartition(16, "slice").mapInArrow(lean(run), "slice int, counts binary").toLocalIterator():
        out[row.slice * size : (row.slice + 1) * size] = np.frombuffer(row.counts, np.uint8)
    return out


def prefixes(docs: DataFrame, n: int, sketch, bits: int) -> DataFrame:
    """Rows (token, class, n, pos) of every class's prefix, rarest first; a class is emitted once a task."""

    def run(batches):
        import pyarrow as pa

        counts, seen = sketch.value, set()
        for _, sets in _sets(batches, 0, n):
            out: list[list] = [[], [], []]
            for _, got in sets:
                size = len(got)
                if not size or (c := class_of(got)) in seen:
                    continue
                seen.add(c)
                keep = size - -(-NUM * size // DEN) + 1
                count = counts[(got >> _U(64 - bits)).astype(np.int64)]
                if keep < size:
                    order = np.argpartition(count, keep - 1)
                    edge = count[order[keep - 1]]
                    some = np.flatnonzero(count <= edge)
                    order = some[np.argsort(count[some], kind="stable")][:keep]
                else:
                    order = np.argsort(count, kind="stable")
                out[0].append(got[order].view(np.int64))
                out[1].append(np.full(keep, c, np.int64))
                out[2].append((size << 32) + np.arange(keep, dtype=np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["token", "class", "place"])

    return docs.select("text").mapInArrow(lean(run), "token long, class long, place long")


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of classes with a common prefix token that pass the length and the positional filter, each once."""
    rows = written(rows.repartition("token"), "prefixes")
    hot = written(rows.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT).select("token", F.ceil(F.col("m") / HOT).cast("int").alias("g")), "hot")
    # a hot token's classes are dealt to g parts; every two parts, and each with itself, meet in one cell
    parts = rows.join(hot, "token").withColumn("i", F.pmod(F.xxhash64("class"), "g").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cell = ["token", "lo", "hi"]
    parts = parts.select("token", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "class", "place").repartition(*cell)
    left = parts.selectExpr(*cell, "i as ia_", "class as a", "place as pa")
    right = parts.selectExpr(*cell, "i as ib_", "class as b", "place as pb")
    split = left.join(right, cell).where("lo = hi or ia_ <> ib_").select("a", "b", "pa", "pb")
    rest = rows.join(hot, "token", "left_anti")
    plain = rest.selectExpr("token", "class as a", "place as pa").join(rest.selectExpr("token", "class as b", "place as pb"), "token").select("a", "b", "pa", "pb")
    pairs = plain.unionByName(split).where("a <> b")
    pairs = pairs.selectExpr("a", "b", "shiftright(pa, 32) as na", "shiftright(pb, 32) as nb", "pa & 4294967295 as ia", "pb & 4294967295 as ib")
    both = f"(na < nb or (na = nb and a < b)) and {DEN} * na >= {NUM} * nb"
    bound = f"{NUM + DEN} * least(na - ia, nb - ib) >= {NUM} * (na + nb)"
    pairs = written(pairs.where(f"{both} and {bound}").select("a", "b", "na", "nb").distinct(), "pairs")
    forget(rows)
    return pairs


def _suffix_and_exact(x, y, cx, cy, nx: int, ny: int) -> bool:
    """Whether DEN * |x & y| >= NUM * |x | y|: first by the suffix filter, then exactly."""
    need = -(-NUM * (nx + ny) // (NUM + DEN))
    if int(np.abs(cx - cy).sum()) > nx + ny - 2 * need:
        return False
    both = np.concatenate((x, y))
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= need


def verified(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar."""
    spark = docs.sparkSession
    ends = written(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "ends")
    filter_ = spark.sparkContext.broadcast(bloom(ends, bits_for(12 * ends.count(), 16, BLOOM_BITS)))
    at = written(in_units(pairs.select("a", "b", (F.col("na") * 8).alias("wa"), (F.col("nb") * 8).alias("wb")), CELL, CELL_BYTES), "units")
    wanted = at.select("unit", F.col("a").alias("class")).unionByName(at.select("unit", F.col("b").alias("class"))).distinct()

    def found(batches):
        import pyarrow as pa

        bits, seen = filter_.value, set()
        for _, sets in _sets(batches, 0, n):
            some = [(class_of(got), got) for _, got in sets if len(got)]
            hit = in_bloom(bits, np.array([c for c, _ in some], np.int64))
            ids, raws = [], []
            for (c, got), yes in zip(some, hit):
                if yes and c not in seen:
                    seen.add(c)
                    ids.append(c)
                    raws.append(got.tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary())], ["class", "set"])

    sets = docs.select("text").mapInArrow(lean(found), "class long, set binary")
    sets = sets.groupBy("class").agg(F.first("set").alias("set"))
    members = wanted.join(sets, "class").select("unit", F.lit(0).alias("kind"), F.col("class").alias("a"), F.lit(0).cast("long").alias("b"), "set")
    rows = members.unionByName(at.select("unit", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("set")))

    def check(batches):
        import pyarrow as pa

        unit, held = None, {}
        for batch in batches:
            units, kinds, sets = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4)
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good: tuple[list, list] = ([], [])
            for i, u in enumerate(units):
                if u != unit:
                    unit, held = u, {}
                if kinds[i] == 0:
                    got = np.frombuffer(sets[i].as_py(), _U)
                    held[a[i]] = got, np.bincount((got >> _U(58)).astype(np.int64), minlength=RANGES), len(got)
                else:
                    (x, cx, nx), (y, cy, ny) = held[a[i]], held[b[i]]
                    if _suffix_and_exact(x, y, cx, cy, nx, ny):
                        good[0].append(a[i])
                        good[1].append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in good], ["a", "b"])

    return rows.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(lean(check), "a long, b long")


def similar(docs: DataFrame, n: int = N) -> DataFrame:
    """For docs(doc_id, text): doc_id, n_shingles, class, n_similar and component_id of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = bits_for(size_of(docs) / PLACE, 16, SKETCH_BITS)
    first = written(classes_and_sketch(docs, n, bits), "classes")
    sketch = add_up(first.where("slice is not null").select("slice", "counts"), bits)
    rows = first.where("slice is null").select("doc_id", "n_shingles", "class")
    pairs = candidates(prefixes(docs, n, spark.sparkContext.broadcast(sketch), bits))
    links = written(verified(docs, pairs, n), "links")
    members = rows.where("n_shingles > 0").groupBy("class").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("least"))
    both = links.unionByName(links.selectExpr("b as a", "a as b"))
    others = both.join(members, both.b == members["class"]).groupBy("a").agg(F.sum("m").alias("others"))
    roots = components(links)
    found = members.join(roots, members["class"] == roots.node, "left").join(others, members["class"] == others.a, "left")
    found = found.select("class", "least", "m", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "class").alias("root"))
    found = written(found, "found")
    roots = found.groupBy("root").agg(F.min("least").alias("component_id"))
    found = found.join(roots, "root").select("class", (F.col("m") - 1 + F.col("others")).alias("n_similar"), "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", "class", F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"))
    out = rows.where("n_shingles > 0").join(found, "class").select("doc_id", "n_shingles", "class", "n_similar", "component_id")
    return out.unionByName(alone)


def deduplicated(docs: DataFrame, n: int = N) -> DataFrame:
    """docs (with doc_id and text) without near-duplicates: of each component the row with the least doc_id stays, of equal rows one.

    Texts without words are linked with nothing and all stay; null doc_ids come after all others.
    """
    key, w, v = free(docs, "_key", "_w", "_v")
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    found = written(similar(keyed.select(F.col(key).alias("doc_id"), "text"), n), "similar")
    ids = keyed.select(F.col(key).alias("key"), F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key).alias("key")).alias("order"))
    groups = found.where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id").distinct().join(ids, "key")
    kept = groups.groupBy("component_id").agg(F.min("order").alias("order")).select(F.col("order.key").alias("key"))
    kept = kept.unionByName(found.where("n_shingles = 0").select(F.col("doc_id").alias("key")).distinct())
    kept = written(kept, "kept")
    # Rows that a filter of bounded size clears stay where they are; only the others, with their texts, are joined.
    many = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    doubtful = written(many.join(kept.withColumn("stays", F.lit(True)), "key", "left").where("n > 1 or stays is null").select("key"), "doubtful")
    bits = bits_for(12 * doubtful.count(), 16, DOUBT_BITS)
    bit = lambda c: F.pmod(c, F.lit(1 << bits))
    words = doubtful.groupBy(F.shiftright(bit("key"), 6).alias(w)).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(key, {1 << bits}) % 64 as int)))").alias(v))
    marked = keyed.withColumn(w, F.shiftright(bit(key), 6)).join(F.broadcast(written(words, "doubt")), w, "left")
    hit = F.coalesce(F.expr(f"shiftright(`{v}`, cast(pmod(`{key}`, {1 << bits}) % 64 as int)) & 1 = 1"), F.lit(False))
    clear = marked.where(~hit).select(*docs.columns)
    blank = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD)
    rest = marked.where(hit).select(key, *docs.columns).join(kept.withColumnRenamed("key", key), key, "left_semi")
    rest = rest.where(~blank).dropDuplicates([key]).unionByName(rest.where(blank))
    return clear.unionByName(rest.select(*docs.columns))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similar(docs).select("doc_id", "n_shingles", "n_similar", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), i AS (SELECT r, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM w),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM i),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.r JOIN n y ON b = y.r WHERE 100 * c >= 90 * (x.n + y.n - c)),
t AS (SELECT r AS a, r AS b FROM w UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
g AS (SELECT a, min(doc_id) AS component_id FROM t JOIN w ON t.b = w.r GROUP BY a), k AS (SELECT a, count(*) AS m FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, 0)::BIGINT AS n_similar, component_id
FROM w d LEFT JOIN n USING (r) JOIN g ON d.r = g.a LEFT JOIN k ON d.r = k.a
"""
