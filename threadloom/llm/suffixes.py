"""Operator 10: removal of every byte that a 200-byte string covers which also starts elsewhere.

Sorting all suffixes of a large corpus moves every byte several times, so the corpus is first cut down, without
loss, to the places where a repeated string can start:

1. Every 200-byte window picks its anchor, the 64-byte string in it with the least hash (the leftmost of equals).
   The windows with one anchor make a run, and the run's bytes are its context. Equal windows have equal anchors
   at equal distances, so windows need comparing only where anchors are equal. About one byte in 70 is an anchor.
2. Anchors that occur once are dropped, first by a sketch of fixed size and then exactly. Equal contexts are
   repeated as a whole; of each, one goes on.
3. Distinct contexts with equal anchors meet in one place, where their suffixes are sorted by the difference-cover
   algorithm: suffixes at positions 1 and 2 modulo 3 are sorted by triples, named, and sorted by recursion on the
   names; the others follow from their first byte and the next one's rank, and both are merged. Neighbours in that
   order whose first 200 bytes agree are repeated windows.

An anchor's contexts meet in one task while there are at most HOT. The contexts of anchors with more are sorted across tasks by the same
algorithm (`ranked`): triples are named by a global range sort and prefix sums over its ranges, the recursion runs
on the names, and the remaining suffixes are merged by range sorts against each half of the sample. Both give the same
windows. Contexts of anchors that the sketch finds frequent are grouped by anchor and context together first, so no task takes all rows of one anchor.

Fingerprints have 64 bits. Cases: null is empty; texts below 200 bytes lose nothing; repeated rows of at least 200
bytes lose everything; null doc_ids are rows like any other; very long texts are cut into overlapping segments
that share no window; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bits_for, bloom, forget, in_bloom, lean, mix64, size_of, text_bytes, written

LENGTH = 200
GRAM = 64
#: Bits of the sketch's and the filter's places at most: 128 MB and 32 MB are broadcast.
SKETCH_BITS, BLOOM_BITS = 26, 28
#: Bytes of input for each place of the sketch.
PLACE = 32
#: Contexts of one anchor that a task sorts at most (some 3 MB); more are sorted across tasks.
HOT = 10_000
#: Distinct keys of a range of the distributed sort, about.
RANGE = 500_000
BLOCK = 1_000_000
SEGMENT = 8_000_000
#: Characters that are suffix-sorted together, about.
SORTED = 1_000_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_tables: dict = {}


def _powers(n: int):
    t = _tables
    if len(t.get("up", ())) < n:
        t["codes"] = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
        for name, base in (("up", _BASE), ("down", _U(pow(int(_BASE), -1, 1 << 64)))):
            x = np.full(n, base, _U)
            x[0] = 1
            t[name] = np.multiply.accumulate(x)
    return t["codes"], t["up"], t["down"]


def prefix_sums(text: np.ndarray):
    """(sums, down): (sums[e] - sums[s]) * down[s] is the fingerprint of text[s:e]."""
    codes, up, down = _powers(max(len(text) + 1, BLOCK))
    sums = np.zeros(len(text) + 1, _U)
    np.cumsum(codes[text] * up[: len(text)], out=sums[1:])
    return sums, down


def _segments(offsets: np.ndarray, length: int):
    """Blocks of (row, first byte, byte after the last): rows of at least `length` bytes, long ones in segments."""
    out, total = [], 0
    for row in np.flatnonzero(np.diff(offsets) >= length):
        a, end = int(offsets[row]), int(offsets[row + 1])
        while True:
            b = min(end, a + SEGMENT)
            out.append((int(row), a, b))
            total += b - a
            if total >= BLOCK:
                yield out
                out, total = [], 0
            if b == end:
                break
            a = b - length + 1
    if out:
        yield out


def anchors_of(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Yields arrays (row, start in its row, anchor, context, last start - start, anchor's place - start) of all runs."""
    wide = length - gram + 1
    for block in _segments(offsets, length):
        text = np.concatenate([raw[a:b] for _, a, b in block])
        n = len(text)
        sums, down = prefix_sums(text)
        grams = mix64((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])
        key = (grams & ~_U((1 << 24) - 1)) | np.arange(len(grams), dtype=_U)
        least, have = key, 1
        while have * 2 <= wide:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < wide:
            least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :])
        sizes = np.array([b - a for _, a, b in block])
        starts = np.concatenate(([0], np.cumsum(sizes)))
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, starts[:-1], 1)
        np.add.at(step, starts[1:] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        place = (least[at] & _U((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        s0, s1, p = at[first], at[last], place[first]
        which = np.searchsorted(starts, s0, side="right") - 1
        context = mix64((sums[s1 + length] - sums[s0]) * down[s0] + ((s1 - s0) * 256 + (p - s0)).astype(_U) * _BASE)
        rows = np.array([r for r, _, _ in block])[which]
        begin = np.array([a for _, a, _ in block])[which] - starts[:-1][which] - offsets[rows]
        yield rows, s0 + begin, grams[p], context, s1 - s0, p - s0


def anchors_and_sketch(docs: DataFrame, length: int, gram: int, bits: int) -> DataFrame:
    """One pass over docs(key, text): rows (anchor, context, key, place), and rows (slice, counts) of the sketch."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        counts, names = np.zeros(1 << bits, np.uint16), ["anchor", "context", "key", "place", "slice", "counts"]
        seen: set[int] = set()
        with np.errstate(over="ignore"):
            for batch in batches:
                keys = batch.column(0).to_numpy()
                new = [i for i, k in enumerate(keys.tolist()) if k not in seen and not seen.add(k)]
                batch = batch.take(pa.array(new, pa.int64()))
                keys = batch.column(0).to_numpy()
                raw, offsets = text_bytes(batch.column(1))
                for rows, s0, anchor, context, run_, put in anchors_of(raw, offsets, length, gram):
                    slot, times = np.unique((anchor >> _U(64 - bits)).astype(np.int64), return_counts=True)
                    counts[slot] += np.minimum(times, 65535 - counts[slot].astype(np.int64)).astype(np.uint16)
                    k = len(rows)
                    columns = [anchor.view(np.int64), context.view(np.int64), keys[rows], s0 << 16 | run_ << 8 | put]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if counts.any():
            pack = zstandard.ZstdCompressor(level=1)
            parts = [pack.compress(x.tobytes()) for x in np.split(counts, 16)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(16, pa.int64()) for _ in range(4)), pa.array(range(16), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(lean(run), "anchor long, context long, key long, place long, slice int, counts binary")


def add_up(slices: DataFrame, bits: int) -> np.ndarray:
    """The sketch, from every task's slices; what comes to the driver has the sketch's fixed size."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_py()), np.uint16)
                if k in totals:
                    totals[k] += np.minimum(part, np.uint16(65535) - totals[k])
                else:
                    totals[k] = part.copy()
        for k, x in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "counts"])

    out = np.zeros(1 << bits, np.uint16)
    size = len(out) // 16
    for row in slices.repartition(16, "slice").mapInArrow(lean(run), "slice int, counts binary").toLocalIterator():
        out[row.slice * size : (row.slice + 1) * size] = np.frombuffer(row.counts, np.uint16)
    return out


def frequent(rows: DataFrame, sketch, bits: int, hot: int) -> DataFrame:
    """The rows whose anchor may occur twice, with `often` where the sketch counts more than `hot`."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            count = sketch.value[(batch.column(0).to_numpy().view(_U) >> _U(64 - bits)).astype(np.int64)]
            keep = np.flatnonzero(count >= 2)
            got = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(count[keep] > hot)], ["anchor", "context", "key", "place", "often"])

    return rows.mapInArrow(lean(run), "anchor long, context long, key long, place long, often boolean")


def compared(rows: DataFrame, hot: int) -> DataFrame:
    """Rows (kind, anchor, key, place): kind 0 is repeated as a whole; 1 is to be compared within its anchor; 2 as well, but across tasks, as the anchor has more than `hot` contexts."""
    names = ["kind", "anchor", "key", "place"]

    def groups(batches):
        """The arrays of whole anchors, or of HOT rows and more of one."""
        held = None
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy() for i in range(4)])
            held = now if held is None else np.concatenate((held, now), axis=1)
            if held.shape[1] < 50_000:
                continue
            cut = np.searchsorted(held[0], held[0, -1])
            if cut:
                yield held[:, :cut]
                held = held[:, cut:]
        if held is not None and held.shape[1]:
            yield held

    def run(batches):
        import pyarrow as pa

        for a, c, key, place in groups(batches):
            new_a = np.concatenate(([True], a[1:] != a[:-1]))
            new_c = new_a | np.concatenate(([True], c[1:] != c[:-1]))
            g, h = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
            many = np.bincount(h)[h] >= 2
            kinds = np.bincount(g[new_c])[g]
            whole = np.flatnonzero(many)
            other = np.flatnonzero(new_c & (kinds >= 2))
            i = np.concatenate((whole, other))
            kind = np.concatenate((np.zeros(len(whole), np.int32), np.where(kinds[other] > hot, 2, 1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x[i]) for x in (a, key, place))], names)

    schema = "kind int, anchor long, key long, place long"
    plain = rows.where("not often").drop("often").repartition("anchor").sortWithinPartitions("anchor", "context").mapInArrow(lean(run), schema)
    often = rows.where("often")
    each = often.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("one"))
    each = written(each, "each")
    twice = often.join(each.where("n >= 2").select("anchor", "context"), ["anchor", "context"]).select(F.lit(0).alias("kind"), "anchor", "key", "place")
    kinds = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds >= 2")
    ones = each.join(kinds, "anchor").select(F.when(F.col("kinds") > hot, 2).otherwise(1).alias("kind"), "anchor", "one.key", "one.place")
    return plain.unionByName(twice).unionByName(ones)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of s (whole numbers from 1), by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s.astype(_U), np.zeros(3, _U)))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    width = _U(int(t.max()).bit_length())
    triple = (t[sample] << (width + width)) | (t[sample + 1] << width) | t[sample + 2]
    order = np.argsort(triple, kind="stable")
    ordered = triple[order]
    name = np.cumsum(np.concatenate(([1], (ordered[1:] != ordered[:-1]).astype(np.int64))))
    if name[-1] < len(sample):
        names = np.empty(len(sample), np.int64)
        names[order] = name
        order = suffix_array(names)
    rank = np.zeros(n + 3, _U)
    sampled = sample[order]
    rank[sampled] = np.arange(1, len(sampled) + 1, dtype=_U)
    sampled = sampled[sampled < n]
    wide = _U(int(n + 1).bit_length())
    rest = np.arange(0, n, 3)
    by_one = (t[rest] << wide) | rank[rest + 1]
    o = np.argsort(by_one, kind="stable")
    rest, by_one = rest[o], by_one[o]
    by_two = (t[rest] << (width + wide)) | (t[rest + 1] << wide) | rank[rest + 2]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted((t[first] << wide) | rank[first + 1], by_one) + np.searchsorted((t[second] << (width + wide)) | (t[second + 1] << wide) | rank[second + 2], by_two)
    out = np.empty(n, np.int64)
    mine = before + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[mine] = True
    out[mine] = rest
    out[~taken] = sampled
    return out


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each context, the starts whose `length` bytes also start elsewhere in the contexts."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    at = np.concatenate(([0], np.cumsum(sizes)))
    # one separator after each context, below every byte
    s = np.zeros(len(text) + len(contexts), np.int64)
    shift = np.repeat(np.arange(len(contexts)), sizes)
    s[np.arange(len(text)) + shift] = text.astype(np.int64) + 2
    s[at[1:] + np.arange(len(contexts))] = 1
    order = suffix_array(s)
    begin = at[:-1] + np.arange(len(contexts))
    which = np.searchsorted(begin, order, side="right") - 1
    good = order - begin[which] <= sizes[which] - length
    order, which = order[good], which[good]
    plain = order - which
    sums, down = prefix_sums(text)
    prefix = (sums[plain + length] - sums[plain]) * down[plain]
    same = prefix[1:] == prefix[:-1]
    hit = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    where, starts = which[hit], (order - begin[which])[hit]
    back = np.lexsort((starts, where))
    return np.split(starts[back], np.searchsorted(where[back], np.arange(1, len(contexts))))


def _runs(starts: np.ndarray):
    """(first, last) of the runs of consecutive whole numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return zip(starts[np.concatenate(([0], cut + 1))].tolist(), starts[np.concatenate((cut, [len(starts) - 1]))].tolist())


def spans_by_sort(contexts: DataFrame, length: int) -> DataFrame:
    """(key, start, stop) of repeated windows, from rows (anchor, key, start, context)."""

    def run(batches):
        import pyarrow as pa

        def solve(some):
            out: list[list] = [[], [], []]
            with np.errstate(over="ignore"):
                got = repeated_starts([x[3] for x in some], length)
            for (_, key, start, _), hit in zip(some, got):
                for a, b in _runs(hit) if len(hit) else ():
                    for column, x in zip(out, (key, start + a, start + b + length)):
                        column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["key", "start", "stop"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SORTED and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(lean(run), "key long, start long, stop long")


def below(rows: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Of each distinct key, how many rows (those whose column of `counts` is 1) have smaller keys: a global range sort and prefix sums."""
    each = written(rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts]), "keys")
    ranges = 1 + each.count() // RANGE
    each = written(each.repartitionByRange(ranges, *keys).withColumn("range", F.spark_partition_id()), "ranges")
    totals = sorted(each.groupBy("range").agg(*[F.sum(c).alias(c) for c in counts]).collect(), key=lambda r: r["range"])
    chained, ahead = [], [0] * len(counts)
    for r in totals:
        chained.append((r["range"], *ahead))
        ahead = [x + r[c] for x, c in zip(ahead, counts)]
    chained = rows.sparkSession.createDataFrame(chained, "range int, " + ", ".join(f"ahead_{c} long" for c in counts))
    before = W.partitionBy("range").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    return each.join(F.broadcast(chained), "range").select(*keys, *[(F.col(f"ahead_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(f"less_{c}") for c in counts])


def ranked(strings: DataFrame, length: int, covered: int = 1) -> DataFrame:
    """(id, r): of each suffix of strings(id, c: array of whole numbers from 1) one more than how many are smaller, by tasks that
    each hold a range. Suffixes that agree on `length` characters may be equal. A number of `c` stands for `covered` characters.

    The difference cover is {1, 2} modulo 3: suffixes there are named by the order of their triples, and sorted by recursion on the names.
    """
    if covered >= length:
        return strings.select("id", F.col("c").alias("r"))
    at = lambda i: F.coalesce(F.get("c", i), F.lit(0).cast("long"))
    places = F.sequence(F.lit(0), F.size("c") - 1)
    mine = lambda m: F.filter(places, lambda i: i % 3 == m)
    if covered == 1:  # triples of bytes are their own names
        name = lambda i: F.shiftleft(at(i), 18) + F.shiftleft(at(i + 1), 9) + at(i + 2)
        halves = [strings.select((F.col("id") * 2 + (m - 1)).alias("id"), F.transform(mine(m), name).alias("c")) for m in (1, 2)]
        names, settled = halves[0].unionByName(halves[1]).where("size(c) > 0"), False
    else:
        triple = lambda m: F.transform(mine(m), lambda i: F.struct((F.col("id") * 2 + (m - 1)).alias("id"), F.floor(i / 3).alias("i"), at(i).alias("x"), at(i + 1).alias("y"), at(i + 2).alias("z")))
        rows = written(strings.select(F.explode(F.concat(triple(1), triple(2))).alias("t")).select("t.*", F.lit(1).cast("long").alias("n")), "triples")
        order = written(below(rows, ["x", "y", "z"], ["n"]), "order")
        settled = order.count() == rows.count()
        names = rows.join(order, ["x", "y", "z"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("less_n") + 1).alias("c")))).alias("c"))
        names = names.select("id", F.transform("c", lambda t: t["c"]).alias("c"))
    names = written(names, "names")
    sample = names.select("id", F.col("c").alias("r")) if settled else ranked(names, length, covered * 3)
    half = lambda m: F.max(F.when(F.pmod("id", F.lit(2)) == m - 1, F.col("r"))).alias(f"r{m}")
    sample = sample.groupBy(F.floor(F.col("id") / 2).alias("of")).agg(half(1), half(2))
    both = strings.join(sample, strings.id == sample.of, "left")
    rank = lambda i: F.coalesce(F.when(i % 3 == 1, F.get("r1", F.floor(i / 3).cast("int"))).when(i % 3 == 2, F.get("r2", F.floor(i / 3).cast("int"))), F.lit(0).cast("long"))
    one = lambda i: F.struct(i.alias("i"), rank(i).alias("own"), at(i).alias("x"), at(i + 1).alias("y"), rank(i + 1).alias("u"), rank(i + 2).alias("v"))
    rows = both.select("id", F.explode(F.transform(places, one)).alias("t")).select("id", "t.*")
    kind = lambda m: (F.col("i") % 3 == m).cast("long").alias(f"n{m}")
    rows = written(rows.select("*", kind(0), kind(1), kind(2)), "suffixes")
    # the others against each half of the sample: by what is common to the places of both
    first = below(rows.where("n2 = 0"), ["x", "u"], ["n0", "n1"]).withColumnsRenamed({"less_n0": "a0", "less_n1": "a1"})
    second = below(rows.where("n1 = 0"), ["x", "y", "v"], ["n0", "n2"]).withColumnsRenamed({"less_n0": "b0", "less_n2": "b2"})
    met = rows.join(first, ["x", "u"], "left").join(second, ["x", "y", "v"], "left")
    place = F.when(F.col("n0") == 1, 1 + F.col("a0") + F.col("a1") + F.col("b2")).when(F.col("n1") == 1, F.col("own") + F.col("a0")).otherwise(F.col("own") + F.col("b0"))
    met = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", place.alias("r")))).alias("r"))
    return written(met.select("id", F.transform("r", lambda t: t["r"]).alias("r")), "ranks")


def spans_by_distributed_sort(contexts: DataFrame, length: int) -> DataFrame:
    """The same, with the suffixes of all contexts in one order across tasks."""
    contexts = written(contexts.withColumn("id", F.monotonically_increasing_id()), "hot")
    codes = contexts.select("id", F.expr("transform(sequence(1, octet_length(context)), i -> cast(conv(hex(substring(context, i, 1)), 16, 10) as long) + 1)").alias("c"))
    ranks = ranked(written(codes, "codes"), length)
    names = ["r", "window", "key", "start"]

    def windows(batches):
        import pyarrow as pa

        with np.errstate(over="ignore"):
            for batch in batches:
                for key, start, raw, r in zip(*(c.to_pylist() for c in batch.columns)):
                    sums, down = prefix_sums(np.frombuffer(raw, np.uint8))
                    k = len(raw) - length + 1
                    got = mix64((sums[length:] - sums[:k]) * down[:k])
                    yield pa.RecordBatch.from_arrays([pa.array(r[:k], pa.int64()), pa.array(got.view(np.int64)), pa.array(np.full(k, key)), pa.array(np.arange(k) + start)], names)

    rows = contexts.join(ranks, "id").select("key", "start", "context", "r").mapInArrow(lean(windows), "r long, window long, key long, start long")
    ranges = 1 + contexts.count() // (RANGE // 100)
    rows = written(rows.repartitionByRange(ranges, "r", "key", "start").withColumn("range", F.spark_partition_id()), "windows")
    # neighbours across the ranges' ends
    order = F.struct("r", "key", "start")
    ends = sorted(rows.groupBy("range").agg(F.min_by("window", order).alias("first"), F.max_by("window", order).alias("last")).collect(), key=lambda e: e["range"])
    beside = [(e["range"], b["last"] if b else None, a["first"] if a else None) for e, b, a in zip(ends, [None, *ends], [*ends[1:], None])]
    beside = rows.sparkSession.createDataFrame(beside, "range int, before long, after long")
    by = W.partitionBy("range").orderBy("r", "key", "start")
    rows = rows.join(F.broadcast(beside), "range").withColumn("before", F.coalesce(F.lag("window").over(by), "before")).withColumn("after", F.coalesce(F.lead("window").over(by), "after"))
    return rows.where("window = before or window = after").select("key", "start", (F.col("start") + length).alias("stop"))


def merged(spans: DataFrame) -> DataFrame:
    """spans(key, start, stop) with those that overlap or touch joined, within blocks of 2**20 bytes: a long text's list holds runs, not windows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            key, block, start, stop = (batch.column(i).to_numpy() for i in range(4))
            # a row begins a run where it lies beyond all stops before it in its block
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
            reach = stop - start[0]
            span = int(max(reach.max(), (start - start[0]).max())) - int(min(reach.min(), 0)) + 1
            group = np.cumsum(new) - 1
            most = np.maximum.accumulate(group * span + (stop - stop.min()))
            at = np.flatnonzero(new | np.concatenate(([False], (start[1:] - stop.min()) + group[1:] * span > most[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(start[at]), pa.array(np.maximum.reduceat(stop, at))], ["key", "start", "stop"])

    blocks = spans.withColumn("block", F.shiftright("start", 20)).select("key", "block", "start", "stop").repartition("key", "block")
    return blocks.sortWithinPartitions("key", "block", "start").mapInArrow(lean(run), "key long, start long, stop long")


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) with the 64-bit `key` of each text, and rows (doc_id, key, n_bytes, sha): texts that differ have different keys.

    Where keys of different texts agree (as a corpus of some 10**10 texts has them), these texts take others.
    """
    key = F.xxhash64("text")
    while True:
        keyed = docs.withColumn("key", key)
        rows = written(keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "rows")
        check = F.xxhash64("sha")
        same = written(rows.groupBy("key").agg(F.min(check).alias("a"), F.max(check).alias("b")).where("a <> b").select("key"), "same")
        if same.isEmpty():
            return keyed, rows
        shas = [r.sha for r in rows.join(same, "key", "left_semi").select("sha").distinct().collect()]
        key = F.when(F.sha2("text", 256).isin(shas), F.xxhash64(F.lit(len(shas)), F.sha2("text", 256), key)).otherwise(key)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """For docs(doc_id, text): rows (doc_id, key, n_bytes, sha, copies), and per key (key, text, removed): merged spans of bytes to remove.

    The spans of texts that occur in several rows aren't among the second: all of such a text goes.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs, rows = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")))
    bits = bits_for(size_of(docs.select("text")) / PLACE, 16, SKETCH_BITS)
    anchors = written(anchors_and_sketch(docs.select("key", "text"), length, gram, bits), "anchors")
    sketch = add_up(anchors.where("slice is not null").select("slice", "counts"), bits)
    often = int(min(65534, max(hot, 64 * (int(sketch.sum(dtype=np.int64)) / len(sketch) + 1))))
    found = anchors.where("slice is null").select("anchor", "context", "key", "place")
    found = frequent(found, spark.sparkContext.broadcast(sketch), bits, often)
    found = written(compared(found, hot), "compared")
    forget(anchors)
    keys = written(found.select("key").distinct(), "keys")
    filter_ = spark.sparkContext.broadcast(bloom(keys, bits_for(12 * keys.count(), 16, BLOOM_BITS)))

    def touched(batches):
        import pyarrow as pa

        for batch in batches:
            hit = np.flatnonzero(in_bloom(filter_.value, batch.column(0).to_numpy()))
            if len(hit):
                yield batch.take(__import__("pyarrow").array(hit))

    texts = written(docs.where(F.octet_length("text") >= length).select("key", "text").mapInArrow(lean(touched), "key long, text string"), "touched")
    one = texts.dropDuplicates(["key"])
    start = F.shiftright("place", 16)
    size = F.shiftright("place", 8).bitwiseAND(F.lit(255)) + length
    places = found.where("kind > 0").groupBy("key").agg(F.collect_list(F.struct("kind", "anchor", start.alias("start"), size.cast("int").alias("size"))).alias("at"))
    contexts = one.join(places, "key").select("key", F.encode("text", "UTF-8").alias("raw"), F.explode("at").alias("at"))
    contexts = contexts.select("at.kind", "at.anchor", "key", "at.start", F.expr("substring(raw, cast(at.start as int) + 1, at.size)").alias("context"))
    contexts = written(contexts, "contexts")
    spans = found.where("kind = 0").select("key", start.alias("start"), (start + size).alias("stop"))
    spans = spans.unionByName(spans_by_sort(contexts.where("kind = 1").drop("kind"), length))
    across = contexts.where("kind = 2").drop("kind")
    if not across.isEmpty():
        spans = spans.unionByName(spans_by_distributed_sort(across, length))
    spans = merged(spans).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(copies, "key")
    single = rows.where(f"copies = 1 and n_bytes >= {length}").select("key")
    return rows, one.join(spans, "key").join(single, "key", "left_semi")


def _kept(batches):
    """(key, n_removed, n_spans, kept_sha256) of rows (key, text, spans)."""
    import pyarrow as pa

    for batch in batches:
        out: list[list] = [[], [], [], []]
        for key, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            raw, digest, at, gone, runs = text.encode(), hashlib.sha256(), 0, 0, 0
            stop = -1
            for s in spans:
                if s["start"] > stop:
                    digest.update(raw[at : s["start"]])
                    runs += 1
                    gone += s["stop"] - s["start"]
                    at = stop = s["stop"]
                elif s["stop"] > stop:
                    gone += s["stop"] - stop
                    at = stop = s["stop"]
            digest.update(raw[at:])
            for column, x in zip(out, (key, gone, runs, digest.hexdigest())):
                column.append(x)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3])], ["key", "n_removed", "n_spans", "kept_sha256"])


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    rows, spans = without_repeats(docs, length, gram, hot)
    part = written(spans.mapInArrow(lean(_kept), "key long, n_removed long, n_spans long, kept_sha256 string"), "kept")
    out = rows.join(part, "key", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    pick = lambda name, all_, none: F.when(whole, all_).otherwise(F.coalesce(name, none)).alias(name)
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", pick("n_removed", F.col("n_bytes"), zero), pick("n_spans", F.lit(1).cast("long"), zero), pick("kept_sha256", F.lit(hashlib.sha256().hexdigest()), F.col("sha")))


ORACLE = """
WITH h AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, i, md5(substring(x, 2 * i + 1, 400)) AS m FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM h)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY m) AS c FROM s),
g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM c WHERE c > 1),
k AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
a AS (SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY r, k),
t AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS z FROM a),
q AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substring(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM t JOIN h USING (r) GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE kept || substring(x, 2 * last + 1, length(x)) END)) AS kept_sha256
FROM h LEFT JOIN q USING (r)
"""
