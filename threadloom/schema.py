"""The normalised conversation: nested as sources deliver it, and exploded into messages as operators take it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.pytext import or_else

EXTRA = "struct<author_name: string, image_refs: array<string>, language: string, source_domain: string>"
MESSAGE = f"struct<uuid: string, sender: string, raw_role: string, render_kind: string, text: string, content: array<struct<type: string, text: string>>, extra: {EXTRA}, created_at: string, updated_at: string, index: int>"
SOURCE = "struct<platform: string, original_filename: string, exported_on_raw: string>"
CONVERSATION = f"conv_ord long, uuid string, name string, chat_messages array<{MESSAGE}>, created_at string, updated_at string, source {SOURCE}"


def make_message(uuid, sender, text, index, created_at="", updated_at="", raw_role=None, render_kind="text", extra=None) -> Column:
    """A message; its role follows from the sender where none is given, and its content repeats the text."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    text, sender = as_col(text), as_col(sender)
    role = F.when(sender == "human", "user").otherwise(sender)
    role = role if raw_role is None else or_else(as_col(raw_role), role)
    block = F.struct(F.lit("text").alias("type"), text.alias("text"))
    fields = dict(uuid=as_col(uuid), sender=sender, raw_role=role, render_kind=as_col(render_kind), text=text, content=F.array(block))
    fields |= dict(extra=(F.lit(None) if extra is None else as_col(extra)).cast(EXTRA), created_at=as_col(created_at), updated_at=as_col(updated_at), index=as_col(index).cast("int"))
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def make_conversations(messages: DataFrame, key: str = "conv_ord") -> DataFrame:
    """Nested conversations from rows (key, message) with a message in each; they keep the order of `index`."""
    return messages.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("message.index").alias("i"), "message"))), lambda x: x["message"]).alias("chat_messages"))


def messages_of(conversations: DataFrame, key: str = "conv_ord", *more: str) -> DataFrame:
    """A row a message: key, the columns `more`, and the message's fields; conversations without messages have no row."""
    rows = conversations.select(key, *more, F.posexplode("chat_messages").alias("pos", "m"))
    return rows.select(key, *more, "pos", "m.*")
