"""Exports that hold a conversation as a tree of message nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions.pytext import is_blank, or_else
from ..operators.messages import sender_of
from ..operators.turns import merge_assistant_texts
from . import files

_RAW = "struct<id: string, conversation_id: string, title: string, create_time: double, update_time: double, mapping: map<string, string>>"
_NODE = "struct<message: struct<id: string, author: struct<role: string, name: string>, create_time: double, update_time: double, content: struct<content_type: string, parts: array<variant>, text: string, language: string, result: string, domain: string, name: string>, metadata: struct<is_user_system_message: variant>>>"


def iso(seconds) -> Column:
    """UTC ISO text of seconds since 1970, with microseconds only where there are some; empty where that's no time."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    fine = F.when((s > -62135596800) & (s < 253402300800), F.round(s, 6))
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), fine.cast("decimal(18,6)"))
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.coalesce(F.when(fine == F.floor(fine), whole).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")), F.lit(""))


def _parts(parts: Column) -> tuple[Column, Column]:
    """The parts' texts joined by line ends, and the image references."""
    kind = lambda p: F.schema_of_variant(p)
    get = lambda p, k: F.try_variant_get(p, f"$.{k}", "string")

    def one(p):
        image = get(p, "content_type") == "image_asset_pointer"
        ref = F.nullif(get(p, "asset_pointer"), F.lit(""))
        of_object = F.when(F.coalesce(image, F.lit(False)), F.struct(F.concat(F.lit("[image: "), ref, F.lit("]")).alias("text"), ref.alias("ref")))
        of_object = of_object.otherwise(F.struct(F.nullif(get(p, "text"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref")))
        plain = F.struct(F.nullif(F.try_variant_get(p, "$", "string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"))
        return F.when(kind(p) == "STRING", plain).when(F.startswith(kind(p), F.lit("OBJECT")), of_object)

    found = F.transform(F.coalesce(parts, F.array().cast("array<variant>")), one)
    texts = F.filter(F.transform(found, lambda x: x["text"]), lambda t: t.isNotNull())
    refs = F.filter(F.transform(found, lambda x: x["ref"]), lambda t: t.isNotNull())
    return F.array_join(texts, "\n"), refs


def _truthy(v: Column) -> Column:
    """Whether a JSON value of any type counts as true in Python."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    true = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
    true = true.when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), ~F.to_json(v).isin("[]", "{}")).otherwise(number != 0)
    return F.coalesce(true, F.lit(False))


def classified(nodes: DataFrame) -> DataFrame:
    """nodes(…, m struct of a message) with role, render_kind, text and extra; messages without visible content are dropped."""
    c, role = "m.content.", F.coalesce("m.author.role", F.lit(""))
    kind = F.col(c + "content_type")
    nodes = nodes.withColumn("_texts", _parts(F.col(c + "parts"))[0]).withColumn("_refs", _parts(F.col(c + "parts"))[1])
    system = (role == "system") & _truthy(F.col("m.metadata.is_user_system_message")) & (kind == "text")
    other = role.isin("user", "assistant", "tool")
    text = (
        F.when(kind.isin("text", "multimodal_text"), F.col("_texts"))
        .when(kind.isin("code", "execution_output", "tether_quote"), F.col(c + "text"))
        .when(kind == "tether_browsing_display", F.col(c + "result"))
        .when(kind == "system_error", or_else(c + "text", F.col(c + "name")))
    )
    render = (
        F.when(system, "system_instruction")
        .when(kind == "text", "text")
        .when(kind == "multimodal_text", F.when(F.size("_refs") > 0, "image_ref").otherwise("text"))
        .when(kind == "code", "code")
        .when(kind == "execution_output", "exec_output")
        .when(kind.isin("tether_quote", "tether_browsing_display"), "search_result")
        .when(kind == "system_error", "system_error")
    )
    name = F.col("m.author.name")
    extra = F.struct(
        F.when(system, F.coalesce(name, F.lit(""))).otherwise(F.nullif(name, F.lit(""))).alias("author_name"),
        F.when(other & kind.isin("text", "multimodal_text") & (F.size("_refs") > 0), F.col("_refs")).alias("image_refs"),
        F.when(kind == "code", F.nullif(F.col(c + "language"), F.lit(""))).alias("language"),
        F.when(kind == "tether_quote", F.nullif(F.col(c + "domain"), F.lit(""))).alias("source_domain"),
    )
    rows = nodes.withColumn("role", role).withColumn("render_kind", render).withColumn("text", F.when(system | other, text)).withColumn("extra", extra)
    return rows.where(~is_blank("text") & F.col("render_kind").isNotNull()).drop("_texts", "_refs")


def normalized(rows: DataFrame, raw: str = "raw", platform: str = "chatgpt") -> DataFrame:
    """Conversations from rows(conv_ord, raw JSON text): one exchange, by conv_ord, for all windows and the nesting."""
    r = rows.select("conv_ord", F.from_json(raw, _RAW).alias("r"))
    heads = ["conv_ord", or_else("r.id", or_else("r.conversation_id", "")).alias("uuid"), F.coalesce("r.title", F.lit("")).alias("name"), iso("r.create_time").alias("created_at"), iso("r.update_time").alias("updated_at")]
    nodes = r.select("conv_ord", F.posexplode("r.mapping").alias("pos", "node_id", "node"))
    nodes = nodes.select("conv_ord", "pos", "node_id", F.from_json("node", _NODE)["message"].alias("m")).where("m is not null")
    nodes = classified(nodes)
    at = F.col("m.create_time")
    later = F.when(F.coalesce("m.update_time", F.lit(0.0)) != 0, F.col("m.update_time")).otherwise(at)
    nodes = nodes.select("conv_ord", "pos", or_else("m.id", F.col("node_id")).alias("uuid"), sender_of("role").alias("sender"), "role", "render_kind", "text", "extra", iso(at).alias("created_at"), iso(later).alias("updated_at"), F.coalesce(at, F.lit(0.0)).alias("at"))
    order = W.partitionBy("conv_ord").orderBy("at", "pos")
    nodes = merge_assistant_texts(nodes.withColumn("index", F.row_number().over(order)), "conv_ord")
    nodes = nodes.withColumn("index", F.row_number().over(W.partitionBy("conv_ord").orderBy("index")) - 1)
    message = schema.make_message(*[F.col(c) for c in ("uuid", "sender", "text", "index", "created_at", "updated_at", "role", "render_kind", "extra")])
    nested = schema.make_conversations(nodes.select("conv_ord", message.alias("message")))
    none = F.array().cast(f"array<{schema.MESSAGE}>")
    source = F.struct(F.lit(platform).alias("platform"), F.lit(None).cast("string").alias("original_filename"), F.lit(None).cast("string").alias("exported_on_raw"))
    return r.select(*heads).join(nested, "conv_ord", "left").select("conv_ord", "uuid", "name", F.coalesce("chat_messages", none).alias("chat_messages"), "created_at", "updated_at", source.alias("source"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    return normalized(files.numbered_elements(spark, folder, ".json", True))
