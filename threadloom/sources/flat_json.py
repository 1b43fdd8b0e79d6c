"""Exports with a flat list of messages in each conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.pytext import is_blank, or_else
from . import files

RAW = "struct<uuid: string, id: string, name: string, created_at: string, updated_at: string, chat_messages: array<struct<uuid: string, sender: string, raw_role: string, index: double, text: string, content: array<struct<type: string, text: string>>, created_at: string, updated_at: string>>>"


def text_of(text, content):
    """The text if it isn't blank, else the non-empty text blocks, else the text."""
    blocks = F.filter(F.coalesce(content, F.array().cast("array<struct<type: string, text: string>>")), lambda b: (b["type"] == "text") & (b["text"] != ""))
    return F.when(~is_blank(text), text).when(F.size(blocks) > 0, F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")).otherwise(F.coalesce(text, F.lit("")))


def normalized(rows: DataFrame, raw: str = "raw", platform: str = "claude") -> DataFrame:
    """Conversations from rows(conv_ord, raw JSON text). Within a row: no shuffle."""
    rows = rows.select("conv_ord", F.from_json(raw, RAW).alias("r"))
    uuid, created, updated = or_else("r.uuid", or_else("r.id", "")), F.coalesce("r.created_at", F.lit("")), F.coalesce("r.updated_at", F.lit(""))
    rows = rows.select("conv_ord", uuid.alias("uuid"), F.coalesce("r.name", F.lit("")).alias("name"), created.alias("created_at"), updated.alias("updated_at"), F.coalesce("r.chat_messages", F.array().cast("array<struct<uuid: string, sender: string, raw_role: string, index: double, text: string, content: array<struct<type: string, text: string>>, created_at: string, updated_at: string>>")).alias("ms"))
    ordered = F.array_sort(F.transform("ms", lambda m, i: F.struct(F.coalesce(m["index"], i.cast("double")).alias("k"), i.alias("i"), m.alias("m"))))

    def message(x, i):
        m = x["m"]
        sender = or_else(m["sender"], F.when(m["raw_role"] == "user", "human").otherwise("assistant"))
        own = F.format_string("%s:%04d", F.col("uuid"), i)
        return schema.make_message(or_else(m["uuid"], own), sender, text_of(m["text"], m["content"]), i, or_else(m["created_at"], F.col("created_at")), or_else(m["updated_at"], F.col("updated_at")))

    source = F.struct(F.lit(platform).alias("platform"), F.lit(None).cast("string").alias("original_filename"), F.lit(None).cast("string").alias("exported_on_raw"))
    return rows.select("conv_ord", "uuid", "name", F.transform(ordered, message).alias("chat_messages"), "created_at", "updated_at", source.alias("source"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    return normalized(files.numbered_elements(spark, folder, ".json", False))


__all__ = ["normalized", "read", "text_of"]
