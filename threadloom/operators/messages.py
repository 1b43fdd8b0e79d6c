"""Roles, visible text and emptiness of messages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pytext import is_blank, or_else

#: Share of blank messages from which a conversation counts as empty.
EMPTY = 0.95


def sender_of(role) -> Column:
    role = F.col(role) if isinstance(role, str) else role
    return F.when(role == "user", "human").when(role.isin("assistant", "tool"), role).otherwise("system")


def flat_sender(sender, raw_role) -> Column:
    """The sender of a flat export's message: as given, else by role."""
    return or_else(sender, F.when(F.col(raw_role) == "user", "human").otherwise("assistant"))


def visible_text(text, content) -> Column:
    """The non-empty text blocks, joined by line ends, else the text."""
    content = F.col(content) if isinstance(content, str) else content
    blocks = F.filter(F.coalesce(content, F.array().cast("array<struct<type: string, text: string>>")), lambda b: (b["type"] == "text") & (b["text"] != ""))
    joined = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")
    return F.when(F.size(blocks) > 0, joined).otherwise(F.coalesce(text, F.lit("")))


def message_is_empty(text, content) -> Column:
    content = F.col(content) if isinstance(content, str) else content
    block = F.exists(content, lambda b: (b["type"] == "text") & ~is_blank(b["text"]))
    return is_blank(text) & ~F.coalesce(block, F.lit(False))


def reindexed(messages: DataFrame, key: str, *order: str) -> DataFrame:
    """`index` as the dense position from 0 in the given order."""
    return messages.withColumn("index", (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).cast("int"))


def with_emptiness(conversations: DataFrame, threshold: float = EMPTY) -> DataFrame:
    """Nested conversations with n_messages, n_empty, empty_ratio and is_empty; no messages means empty."""
    empty = F.filter("chat_messages", lambda m: message_is_empty(m["text"], m["content"]))
    out = conversations.withColumn("n_messages", F.coalesce(F.size("chat_messages"), F.lit(0)).cast("long")).withColumn("n_empty", F.coalesce(F.size(empty), F.lit(0)).cast("long"))
    ratio = F.when(F.col("n_messages") > 0, F.col("n_empty") / F.col("n_messages")).otherwise(1.0)
    return out.withColumn("empty_ratio", ratio).withColumn("is_empty", F.col("empty_ratio") >= threshold if threshold <= 1 else F.col("n_messages") == 0)


def empty_stats(messages: DataFrame, key: str, threshold: float = EMPTY) -> DataFrame:
    """The same from messages(key, text), for conversations that have any."""
    found = messages.groupBy(key).agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(is_blank("text")).alias("n_empty"))
    return found.withColumn("empty_ratio", F.col("n_empty") / F.col("n_messages")).withColumn("is_empty", F.col("empty_ratio") >= threshold)
