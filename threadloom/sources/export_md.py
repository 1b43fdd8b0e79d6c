"""Markdown transcripts, one conversation a file. The line grammar is set logic within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.names import stem_of
from ..functions.pytext import SPACE, is_blank, join_lines, let, or_else, positions, segmented, splitlines, strip
from . import files

_FENCE = rf"\A[{SPACE}]*```"
_USER = rf"\A##[{SPACE}]+\x{{1F464}}[{SPACE}]+You[{SPACE}]*\z"
_MODEL = rf"\A##[{SPACE}]+\x{{1F916}}[{SPACE}]+Gemini[{SPACE}]*\z"
_RULE = rf"\A---[{SPACE}]*\z"
_EXPORTED = rf"\A>[{SPACE}]*Exported on:[{SPACE}]*(.+?)[{SPACE}]*\z"
_FORMATS = ("y/M/d H:m:s", "y/M/d H:m", "y-M-d H:m:s", "y-M-d'T'H:m:s", "y-M-d")


def transcript_of(c) -> Column:
    """struct<exported_on, parts array<struct<sender, text>>> of a transcript."""
    some = lambda a: F.filter(a, lambda x: x.isNotNull())

    def tagged(lines, fences):
        outside = lambda x, k: ~x.rlike(_FENCE) & (k % 2 == 0)
        one = lambda x, i, k: F.struct(x.alias("x"), i.alias("i"), outside(x, k).alias("out"), x.rlike(_USER).alias("user"), x.rlike(_MODEL).alias("model"), (~is_blank(x)).alias("solid"))
        return segmented(lines, fences, one)

    def with_marks(t):
        found = F.filter(t, lambda y: y["out"] & (y["user"] | y["model"]))
        return let(found, lambda m: let(F.coalesce(F.get(F.filter(m, lambda y: y["user"]), F.lit(0))["i"], F.size(t)), lambda first: rest(t, F.filter(m, lambda y: y["i"] >= first), first)))

    def rest(t, found, first):
        solid = F.filter(t, lambda y: y["solid"])
        # a rule goes where the next line with text is a mark, or where none follows
        ends = lambda s: F.transform(s, lambda y, k: let(F.get(s, k + 1), lambda n: F.when(y["out"] & y["x"].rlike(_RULE) & F.coalesce(n["user"] | n["model"], F.lit(True)), y["i"])))
        gone = lambda s: some(ends(s))
        keep = let(let(solid, gone), lambda g: segmented(t, g, lambda y, i, k: F.struct(y["x"].alias("x"), F.coalesce(i != F.get(g, k), F.lit(True)).alias("keep"))))

        def parts(marks, kept):
            def part(m, k):
                stop = F.coalesce(F.get(marks, k + 1)["i"], F.size(t))
                body = F.filter(F.slice(kept, m["i"] + 2, stop - m["i"] - 1), lambda y: y["keep"])
                return F.struct(F.when(m["user"], "human").otherwise("assistant").alias("sender"), strip(join_lines(F.transform(body, lambda y: y["x"]))).alias("text"))

            return F.transform(marks, part)

        seen = some(F.transform(F.slice(t, 1, first), lambda y: F.when(y["out"] & y["x"].rlike(_EXPORTED), strip(F.regexp_extract(y["x"], _EXPORTED, 1)))))
        return F.struct(F.get(F.reverse(seen), F.lit(0)).alias("exported_on"), let(found, lambda m: let(keep, lambda k: parts(m, k))).alias("parts"))

    return let(splitlines(c), lambda lines: let(positions(lines, lambda x: x.rlike(_FENCE)), lambda f: let(tagged(lines, f), with_marks)))


def parsed(rows: DataFrame) -> DataFrame:
    """rows(…, value) with exported_on and parts."""
    return rows.withColumn("_t", transcript_of("value")).withColumn("exported_on", F.col("_t.exported_on")).withColumn("parts", F.col("_t.parts")).drop("_t")


def exported_at(c) -> Column:
    """The export's time in Japan, as ISO text, or an empty text."""
    c = F.col(c) if isinstance(c, str) else c
    at = F.coalesce(*[F.try_to_timestamp(strip(c), F.lit(f)) for f in _FORMATS])
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+09:00'"), F.lit(""))


def title_of(name) -> Column:
    stem = stem_of(name)
    return F.replace(or_else(F.regexp_extract(stem, r"\A\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}_((?s).+)\z", 1), stem), F.lit("_"), F.lit(" "))


def day_of(name) -> Column:
    return F.nullif(F.regexp_extract(stem_of(name), r"\A(\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2})_(?s).+\z", 1), F.lit(""))


def conversation_id(name, length: int = 12) -> Column:
    return F.substring(F.sha1(name), 1, length)


def normalized(rows: DataFrame, platform: str = "gemini") -> DataFrame:
    """Conversations from rows(conv_ord, file_name, value). Within a row: no shuffle."""
    name = F.col("file_name")
    day = F.coalesce(F.date_format(F.try_to_timestamp(day_of(name), F.lit("yyyy-MM-dd")), "yyyy-MM-dd'T'HH:mm:ss'+09:00'"), F.lit(""))

    def conversation(t, h):
        at = exported_at(t["exported_on"])
        times = F.struct(or_else(h["day"], at).alias("created"), or_else(at, h["day"]).alias("updated"))
        message = lambda w: lambda p, i: schema.make_message(F.format_string("%s:%04d", h["uuid"], i), p["sender"], p["text"], i, w["created"], w["updated"])
        return let(times, lambda w: F.struct(F.transform(t["parts"], message(w)).alias("chat_messages"), w["created"].alias("created_at"), w["updated"].alias("updated_at"), t["exported_on"].alias("exported_on")))

    head = F.struct(conversation_id(name).alias("uuid"), day.alias("day"))
    rows = rows.select("conv_ord", name.alias("file_name"), conversation_id(name).alias("uuid"), let(head, lambda h: let(transcript_of("value"), lambda t: conversation(t, h))).alias("c"))
    source = F.struct(F.lit(platform).alias("platform"), name.alias("original_filename"), F.col("c.exported_on").alias("exported_on_raw"))
    return rows.select("conv_ord", "uuid", title_of(name).alias("name"), "c.chat_messages", "c.created_at", "c.updated_at", source.alias("source"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    return normalized(files.numbered_texts(spark, folder, ".md"))
