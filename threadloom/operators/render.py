"""Conversations as Markdown, and clean-up in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import cleaned, shift_headings
from ..functions.pytext import rstrip
from . import turns


def render(messages: DataFrame, names: DataFrame, key: str, start: int = 0, dedupe: bool = True, shift: bool = False, safe: bool = True) -> DataFrame:
    """(key, md) of every conversation in names(key, name), from messages(key, index, sender, render_kind, text)."""
    pairs = turns.pair_turns(messages, key)
    pairs = turns.label_pairs(turns.dedupe_pairs(pairs, key) if dedupe else pairs, key, start)
    body = lambda c: shift_headings(rstrip(c)) if shift else rstrip(c)
    block = F.concat(
        F.lit("## pcp_"), "label", F.lit("\n\n**A Prompt by User**\n\n"), body(F.coalesce("prompt", F.lit(""))),
        F.lit("\n\n**A Completion by LLM**\n\n"), body(F.coalesce("completion", F.lit(""))), F.lit("\n\n---\n\n"),
    )
    blocks = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b["block"]), "")
    title = F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("# "), "name", F.lit("\n\n"))).otherwise("")
    md = F.concat(title, F.coalesce(text, F.lit("")))
    out = names.join(blocks, key, "left").select(key, F.when(md == "", "\n").otherwise(md).alias("md"))
    return out.select(key, cleaned("md")["text"].alias("md")) if safe else out


def clean_all(docs: DataFrame, *columns: str) -> DataFrame:
    """docs(…, text) with the cleaned text, whether it changed, and what was removed and converted."""
    rows = docs.select(*columns, "text", cleaned("text").alias("c"))
    return rows.select(*columns, F.col("c.text").alias("text"), (F.col("c.text") != F.col("text")).alias("changed"), "c.unsupported_removed", "c.block_math_converted")


def clean_totals(cleaned_docs: DataFrame) -> DataFrame:
    return cleaned_docs.agg(F.count(F.lit(1)).alias("files"), F.sum("unsupported_removed").alias("unsupported_removed"), F.sum("block_math_converted").alias("block_math_converted"))
