"""Turns of a conversation: numbering, merging, prompt-completion pairs, their duplicates and labels.

All windows and groups share the conversation's key, so a plan that chains them has one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.markdown import label_of
from ..functions.pytext import is_blank, strip


def with_turns(messages: DataFrame, key: str, order: str = "index") -> DataFrame:
    """`turn`: the number of human messages up to and with this one."""
    running = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return messages.withColumn("turn", F.sum((F.col("sender") == "human").cast("long")).over(running))


def merge_assistant_texts(messages: DataFrame, key: str, order: str = "index") -> DataFrame:
    """In each turn after a human message, the assistant's non-blank texts joined into the first one's place."""
    rows = with_turns(messages, key, order)
    part = (F.col("sender") == "assistant") & (F.col("render_kind") == "text") & ~is_blank("text") & (F.col("turn") > 0)
    rows = rows.withColumn("_part", F.coalesce(part, F.lit(False)))
    within = W.partitionBy(key, "turn").orderBy(order)
    full = within.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("_nth", F.sum(F.col("_part").cast("int")).over(within.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_all", F.collect_list(F.when(F.col("_part"), F.col("text"))).over(full))
    first = F.col("_part") & (F.col("_nth") == 1) & (F.size("_all") > 1)
    rows = rows.where(~F.col("_part") | (F.col("_nth") == 1))
    return rows.withColumn("text", F.when(first, F.array_join("_all", "\n\n")).otherwise(F.col("text"))).drop("_part", "_nth", "_all", "turn")


def pair_turns(messages: DataFrame, key: str, order: str = "index") -> DataFrame:
    """(key, turn, prompt, completion): each human message with the first assistant text before the next one, if any."""
    rows = with_turns(messages, key, order).where("turn > 0")
    answer = (F.col("sender") == "assistant") & (F.coalesce("render_kind", F.lit("text")) == "text")
    return rows.groupBy(key, "turn").agg(
        F.min_by(F.when(F.col("sender") == "human", F.col("text")), F.when(F.col("sender") == "human", F.col(order))).alias("prompt"),
        F.min_by(F.when(answer, F.col("text")), F.when(answer, F.col(order))).alias("completion"),
    )


def dedupe_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """Of pairs with equal stripped texts the first; pairs that are blank on both sides go."""
    rows = pairs.withColumn("_p", strip(F.coalesce("prompt", F.lit("")))).withColumn("_c", strip(F.coalesce("completion", F.lit(""))))
    rows = rows.where((F.col("_p") != "") | (F.col("_c") != ""))
    nth = F.row_number().over(W.partitionBy(key, "_p", "_c").orderBy("turn"))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n", "_p", "_c")


def label_pairs(pairs: DataFrame, key: str, start: int = 0) -> DataFrame:
    """`label`: the prompt's own, else the next number; only pairs without one use a number up."""
    rows = pairs.withColumn("_own", label_of("prompt"))
    running = W.partitionBy(key).orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    number = F.sum(F.col("_own").isNull().cast("int")).over(running) + (start - 1)
    return rows.withColumn("label", F.coalesce("_own", F.format_string("%03d", number))).drop("_own")
