"""Operator 2: mixing sources to target weights by weighted fair queueing.

A source's documents are shuffled by a hash and served in packets of PACKET words at most, so that a long document
holds up no source. A packet's virtual finish time is the source's cumulative words up to its end divided by the
source's target. All packets are range-sorted by it, globally, and the schedule is truncated where its words reach the
total budget: prefix sums over the ranges find the range with the end, and only in that one rows are added up. What
each source has been served then says what is taken of each of its documents, as a source's packets are served in
the documents' order; so a source ends within about a packet of its target. A source whose target reaches its size goes round
again, up to `most` times.

Cases: null text has size 0 and is taken 0 times; a null source is a source of its own, last in the order of
code points; null doc_ids and repeated rows are rows like any other, each with its own share (equal rows are
ordered as one run, whose parts differ only in which of them the cut meets); an empty table gives an empty
table; very long texts are many packets; columns beside the named ones are kept by `mixed` and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, forget, free, numbered, written

MOST = 3
WEIGHTS = (1, 2, 3)
#: Rows of a source that one window orders.
RUN = 4096
#: Words of a packet at most, and packets of a range of the schedule, about.
PACKET, RANGE = 64, 500_000


def n_words(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], budget: float, most: float = MOST) -> list[float]:
    """Shares of the budget by weight, none above `most` times its size; what is above is shared again by weight."""
    targets, free, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}, float(budget)
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        free -= over
    return targets


def shares(docs: DataFrame, share: float = 1.0, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Of docs(source, size): per source its number `k` in the order of code points, its size, its number of rows and its target.

    What comes to the driver is one row a source; the number of sources is that of a mixing recipe's entries.
    """
    spark = docs.sparkSession
    found = docs.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r.s for r in found]
    targets = water_fill(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], share * sum(sizes), most)
    rows = [(k, r.source, r.s, r.n, t) for k, (r, t) in enumerate(zip(found, targets))]
    return spark.createDataFrame(rows, "k int, source string, source_size long, source_rows long, target double")


def place_of(key: str, source: str, seed: int = 0) -> Column:
    """The hash by which a source's documents are ordered."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), part(key), part(source)))


def scheduled(docs: DataFrame, share: float = 1.0, weights=WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """docs(key, source, size) with source_size, source_rows, target, `k`, `before`: the source's words that come earlier, and `h`, which orders it.

    Sources are split into runs of about RUN rows by hash, so no window holds a source; equal rows are counted
    first and spread again at the end.
    """
    docs = written(docs, "sizes")
    per = shares(docs, share, weights, most)
    rows = docs.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(per, rows.source.eqNullSafe(per.source)).drop(per.source)
    # The leading 32 bits, scaled to the number of runs: runs follow the order of the hash.
    lead = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("h", place_of("key", "source", seed)).withColumn("run", F.shiftright(lead * F.greatest(F.lit(1), F.ceil(F.col("source_rows") / RUN)).cast("long"), 32))
    rows = written(rows, "runs")
    words = F.col("size") * F.col("copies")
    runs = rows.groupBy("source", "run").agg(F.sum(words).alias("w"))
    order = W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("source", "run", F.coalesce(F.sum("w").over(order), F.lit(0)).alias("ahead"))
    within = W.partitionBy("source", "run").orderBy("h", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(words).over(within), F.lit(0)))
    joined = rows.join(runs, rows.source.eqNullSafe(runs.source) & (rows.run == runs.run)).drop(runs.source).drop(runs.run)
    spread = numbered(joined, "copies", "copy")
    return spread.select("key", "source", "size", "k", "source_size", "source_rows", "target", (F.col("ahead") + F.col("inside") + F.col("copy") * F.col("size")).alias("before"), "h")


def schedule(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The queue: a row (range, k, start, words, finish) for each packet of scheduled rows, range-sorted by virtual finish time.

    Each source offers as many rounds as its target needs, and what the budget truncates beyond.
    """
    per = rows.where("size > 0").groupBy("k").agg(F.first("source_size").alias("s"), F.first("source_rows").alias("n"), F.first("target").alias("t"))
    rounds = lambda t, s: F.least(F.lit(most), F.floor(F.col(t) / F.col(s)) + 1)
    packets = per.agg(F.sum(rounds("t", "s") * (F.col("s") / PACKET + F.col("n")))).first()[0] or 0
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(packets // RANGE) + 1)
    out = rows.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), rounds("target", "source_size") - 1)))
    out = numbered(out.withColumn("n", F.ceil(F.col("size") / PACKET)), "n", "p")
    start = F.col("before") + F.col("round") * F.col("source_size") + F.col("p") * PACKET
    out = out.select("k", start.alias("start"), F.least(F.lit(PACKET), F.col("size") - F.col("p") * PACKET).alias("words"), "target")
    out = out.select("k", "start", "words", ((F.col("start") + F.col("words")) / F.col("target")).alias("finish"))
    order = ["finish", "k", "start"]
    return out.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())


def truncated(queue: DataFrame, budget: int) -> DataFrame:
    """The rows (k, words) of a schedule up to `budget` words; the packet at the end is cut."""
    sums = sorted(queue.groupBy("range").agg(F.sum("words").alias("w")).collect(), key=lambda r: r.range)
    last, left = -1, budget
    for r in sums:
        last = r.range
        if r.w >= left:
            break
        left -= r.w
    ahead = W.partitionBy("range").orderBy("finish", "k", "start").rowsBetween(W.unboundedPreceding, -1)
    end = queue.where(F.col("range") == last).withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    end = end.where(F.col("ahead") < left).select("k", F.least(F.col("words"), F.lit(left) - F.col("ahead")).alias("words"))
    return queue.where(F.col("range") < last).select("k", "words").unionByName(end)


def mix(docs: DataFrame, share: float = 1.0, weights=WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """Scheduled rows of docs(key, source, size) with `served`: the words of the source that the truncated queue serves."""
    rows = written(scheduled(docs, share, weights, most, seed), "scheduled")
    total = rows.agg(F.sum("size")).first()[0] or 0
    queue = written(schedule(rows, most), "queue")
    served = truncated(queue, int(min(share, most) * total + 1e-6)).groupBy("k").agg(F.sum("words").alias("served"))
    served = written(served, "served")
    forget(queue)
    return rows.join(served, "k", "left").withColumn("served", F.coalesce("served", F.lit(0)))


def taken(most: int = MOST) -> Column:
    """Words of a row of `mix` served over all its source's rounds."""
    each = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("served") - F.lit(e) * F.col("source_size") - F.col("before"))) for e in range(most)]
    return sum(each[1:], each[0]).cast("long")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix(docs.select(F.col("doc_id").alias("key"), "source", n_words("text").alias("size")))
    return rows.select(F.col("key").alias("doc_id"), "size", "source_size", "target", taken().alias("taken"))


_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"
ORACLE = f"""
WITH d AS (SELECT doc_id, source, {_WORDS} AS size FROM documents),
o AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, ((k - 1) % 3 + 1)::DOUBLE AS weight FROM o),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER q, 0) AS full_before, sum(weight) OVER (ORDER BY source_size / weight DESC, k DESC ROWS UNBOUNDED PRECEDING) AS weight_from FROM w WHERE source_size > 0
  WINDOW q AS (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, sum(source_size) OVER ()::DOUBLE - full_before AS rest FROM c),
f AS (SELECT rest AS rest_, weight_from AS weight_ FROM l WHERE rest * weight / weight_from <= 3 * source_size ORDER BY source_size / weight, k LIMIT 1),
t AS (SELECT w.k, w.source, w.source_size, CASE WHEN w.source_size = 0 THEN 0.0 ELSE least(3.0 * w.source_size, rest_ * weight / weight_) END AS target FROM w LEFT JOIN f ON true),
b AS (SELECT d.doc_id, d.size, t.k, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws('|', '0', coalesce(doc_id::VARCHAR, ''), coalesce(d.source, ''))), doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
rr AS (SELECT *, unnest(range(least(3, floor(target / source_size)::BIGINT + 1))) AS round FROM b WHERE size > 0),
p AS (SELECT *, unnest(range((size + {PACKET - 1}) // {PACKET})) AS p FROM rr),
q AS (SELECT k, target, before + round * source_size + p * {PACKET} AS start, least({PACKET}, size - p * {PACKET}) AS words FROM p),
u AS (SELECT k, words, sum(words) OVER (ORDER BY (start + words) / target, k, start ROWS UNBOUNDED PRECEDING) - words AS ahead FROM q),
e AS (SELECT k, sum(least(words, greatest(0, (SELECT sum(size) FROM d) - ahead)))::BIGINT AS served FROM u GROUP BY k)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  coalesce(greatest(0, least(size, served - before)) + greatest(0, least(size, served - source_size - before)) + greatest(0, least(size, served - 2 * source_size - before)), 0)::BIGINT AS taken FROM b LEFT JOIN e USING (k)
"""


def edges(plan: DataFrame) -> DataFrame:
    """Of a mix, one row a source: how often all is served (`full`), and the place `edge` where one more round ends, with the
    words left for it (`left`) and the number of equal rows there (`copies`)."""
    rows = plan.where("size > 0").withColumn("full", F.expr("served div source_size"))
    rows = rows.withColumn("rest", F.col("served") - F.col("full") * F.col("source_size"))
    at = rows.where("before + size > rest").groupBy("source").agg(F.min("h").alias("edge"))
    found = rows.join(at, rows.source.eqNullSafe(at.source) & (rows.h == at.edge)).drop(at.source)
    return found.groupBy("source", "edge", "full").agg((F.first("rest") - F.min("before")).alias("left"), F.count(F.lit(1)).alias("copies"))


def mixed(docs: DataFrame, share: float = 1.0, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """docs (with text and source) as the mix takes them: whole copies as often as they are served, a cut one to its first words.

    A row's copies follow from its place beside its source's edge, so texts aren't shuffled but for those at an edge. The columns stay the same.
    """
    cols = docs.columns
    names = ["source", "edge", "full", "left", "copies"]
    key, place, size, times, *per_names = free(docs, *(f"_mix_{x}" for x in ("key", "place", "size", "times", *names)))
    source, edge, full, left, copies = map(F.col, per_names)
    keyed = docs.withColumn(key, F.xxhash64(*cols))
    plan = mix(keyed.select(F.col(key).alias("key"), "source", n_words("text").alias("size")), share, weights, most)
    per = written(edges(plan), "edges").select(*[F.col(c).alias(to) for c, to in zip(names, per_names)])
    keyed = keyed.where(F.col("text").rlike(WORD)).withColumn(place, place_of(key, "source"))
    got = keyed.join(per, F.col("source").eqNullSafe(source))
    apart = got.where(F.col(place) != edge).withColumn(times, full + (F.col(place) < edge).cast("long"))
    at = got.where(F.col(place) == edge).dropDuplicates([key]).withColumn(size, n_words("text"))
    at = at.withColumn(times, copies * full + F.floor(left / F.col(size)))
    whole = apart.select(*cols, times).unionByName(at.select(*cols, times)).where(F.col(times) > 0)
    whole = numbered(whole, times, key).select(*cols)
    words = (left % F.col(size)).cast("int")
    head = F.concat_ws("", F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, words))
    cut = at.where(words > 0).withColumn("text", head)
    if "n_chars" in cols:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(cut.select(*cols))
