"""Readable file names: collisions, the mapping table, and its update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import numbered_stem, readable_stem, short_id, stem_of

COLUMNS = "conv_id title created_at old_filename new_filename".split()


def resolved(rows: DataFrame) -> DataFrame:
    """rows(conv_ord, uuid, stem) with final_stem and n_collisions.

    Of the ids with one stem, the k-th to appear gets the suffix _k from the second on; a row without an id is a new one each time.
    """
    who = F.when(F.coalesce("uuid", F.lit("")) == "", F.concat(F.lit("#"), F.col("conv_ord").cast("string"))).otherwise(F.concat(F.lit("="), "uuid"))
    rows = rows.withColumn("_who", who)
    rows = rows.withColumn("_first", F.min("conv_ord").over(W.partitionBy("stem", "_who")))
    rows = rows.withColumn("_k", F.dense_rank().over(W.partitionBy("stem").orderBy("_first")))
    final = F.when(F.col("_k") > 1, F.concat("stem", F.lit("_"), F.col("_k").cast("string"))).otherwise(F.col("stem"))
    return rows.withColumn("final_stem", final).withColumn("n_collisions", (F.col("_k") - 1).cast("long")).drop("_who", "_first", "_k")


def with_stems(conversations: DataFrame, any_unicode: bool = True) -> DataFrame:
    """conversations(conv_ord, uuid, name, created_at, updated_at, source) with stem and old_stem."""
    c = F.col
    stem = readable_stem(c("name"), c("uuid"), c("source.original_filename"), c("created_at"), c("updated_at"), any_unicode)
    return conversations.withColumn("stem", stem).withColumn("old_stem", numbered_stem("conv_ord", "uuid"))


def mapping(resolved_rows: DataFrame) -> DataFrame:
    """The mapping table, with conv_ord to order it by."""
    empty = lambda x: F.coalesce(x, F.lit(""))
    md = lambda x: F.concat(x, F.lit(".md"))
    return resolved_rows.select("conv_ord", empty("uuid").alias("conv_id"), empty("name").alias("title"), empty("created_at").alias("created_at"), md("old_stem").alias("old_filename"), md("final_stem").alias("new_filename"))


def upserted(old: DataFrame, changed: DataFrame, current: DataFrame) -> DataFrame:
    """The table after an update: changed rows over old ones, last row of a conv_id first to count.

    old(ord, mapping columns), changed(conv_ord, mapping columns), current(conv_ord, uuid). `place` orders the result: current
    conversations first, then the rows of others as before. Ids are compared whole.
    """
    last = old.where("conv_id <> ''").groupBy("conv_id").agg(F.max_by(F.struct(*COLUMNS[1:]), "ord").alias("o"), F.min("ord").alias("ord"))
    new = changed.where("conv_id <> ''").groupBy("conv_id").agg(F.max_by(F.struct(*COLUMNS[1:]), "conv_ord").alias("c"))
    both = last.join(new, "conv_id", "full_outer")
    at = current.where("uuid <> ''").groupBy(F.col("uuid").alias("conv_id")).agg(F.min("conv_ord").alias("conv_ord"))
    rows = both.join(at, "conv_id", "left").withColumn("r", F.coalesce("c", "o"))
    place = F.struct(F.col("conv_ord").isNull().alias("orphan"), F.coalesce("conv_ord", "ord", F.lit(1 << 62)).alias("n"))
    return rows.select("conv_id", "r.*", place.alias("place"))


def stale(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Of files(file_name), those named for an earlier state of a changed(uuid, new_filename) conversation: by their id suffix."""
    tail = F.regexp_extract(stem_of(F.col("file_name")), r"__([^_]+)\z", 1)
    ids = changed.select(short_id("uuid").alias("id8"), "new_filename")
    found = files.withColumn("id8", tail).join(ids, "id8")
    return found.where("file_name <> new_filename").select("file_name").distinct()
