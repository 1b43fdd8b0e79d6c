"""Fingerprints, snapshots and the comparison of an export with the last snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import replace

STATUSES = ("new", "updated", "unchanged", "deleted", "skipped_empty")


def json_string(c) -> Column:
    """A JSON string literal with lower-case escapes of control characters, other characters as they are; null for null."""
    c = F.col(c) if isinstance(c, str) else c
    out = replace(replace(c, r"\\", r"\\\\"), '"', r'\\"')
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    escaped = out
    for k in range(32):
        escaped = F.replace(escaped, F.lit(chr(k)), F.lit("\\" + short[k] if k in short else f"\\u{k:04x}"))
    out = F.when(out.rlike(r"[\x00-\x1F]"), escaped).otherwise(out)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def fingerprints(messages: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint): SHA-1 of the JSON list of index, sender, text and uuid of messages(key, uuid, sender, index, text)."""
    item = F.concat(F.lit('{"index": '), F.coalesce(F.col("index").cast("string"), F.lit("null")), F.lit(', "sender": '), json_string("sender"), F.lit(', "text": '), json_string("text"), F.lit(', "uuid": '), json_string("uuid"), F.lit("}"))
    rows = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", item.alias("item")))).alias("items"))
    payload = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ", "), F.lit("]"))
    return rows.select(key, F.sha1(payload).alias("fingerprint"))


def fingerprint_of(chat_messages) -> Column:
    """The same within a row, from nested messages."""
    ordered = F.array_sort(F.transform(chat_messages, lambda m, i: F.struct(m["index"].alias("k"), i.alias("i"), m.alias("m"))))
    item = lambda x: F.concat(F.lit('{"index": '), F.coalesce(x["m"]["index"].cast("string"), F.lit("null")), F.lit(', "sender": '), json_string(x["m"]["sender"]), F.lit(', "text": '), json_string(x["m"]["text"]), F.lit(', "uuid": '), json_string(x["m"]["uuid"]), F.lit("}"))
    return F.sha1(F.concat(F.lit("["), F.array_join(F.transform(ordered, item), ", "), F.lit("]")))


def snapshot(current: DataFrame, skip_empty: bool = True) -> DataFrame:
    """(uuid, name, updated_at, fingerprint, source) of current(conv_ord, uuid, name, updated_at, fingerprint, is_empty, source); of equal ids the last, none without id."""
    rows = current.where(F.coalesce("uuid", F.lit("")) != "")
    rows = rows.where("not is_empty") if skip_empty else rows
    record = F.struct("name", "updated_at", "fingerprint", *(["source"] if "source" in current.columns else []))
    return rows.groupBy("uuid").agg(F.max_by(record, "conv_ord").alias("r")).select("uuid", "r.*")


def classified(current: DataFrame, before: DataFrame, skip_empty: bool = True) -> DataFrame:
    """(conv_ord, uuid, name, status): each current conversation against the snapshot, and the snapshot's deleted ones with conv_ord -1."""
    old = before.select(F.col("uuid").alias("_id"), F.col("name").alias("_name"), F.col("updated_at").alias("_at"), F.col("fingerprint").alias("_print"))
    both = current.join(old, current.uuid == old._id, "full_outer")
    missing, at = F.col("conv_ord").isNull(), lambda c: F.coalesce(c, F.lit(""))
    status = (
        F.when(missing, "deleted")
        .when(at(F.col("uuid")) == "", "updated")
        .when(F.col("is_empty") if skip_empty else F.lit(False), "skipped_empty")
        .when(F.col("_id").isNull(), "new")
        .when((at(F.col("updated_at")) == at(F.col("_at"))) & (F.col("fingerprint") == at(F.col("_print"))), "unchanged")
        .otherwise("updated")
    )
    return both.select(F.coalesce("conv_ord", F.lit(-1).cast("long")).alias("conv_ord"), F.when(missing, F.col("_id")).otherwise(F.col("uuid")).alias("uuid"), F.when(missing, F.col("_name")).otherwise(F.col("name")).alias("name"), status.alias("status"))


def counts(rows: DataFrame) -> DataFrame:
    """One row: how many conversations have each status."""
    return rows.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES])
