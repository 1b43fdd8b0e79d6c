"""The workflows: full export, incremental export against a snapshot, clean-up of a folder."""

from __future__ import annotations

import json
import os
import shutil
import uuid as uuids

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches, diff, mapping, messages, parts, render
from ..schema import messages_of
from ..sources import files, registry, sinks
from .layout import Layout
from .tables import kept

SNAPSHOT = "uuid string, name string, updated_at string, fingerprint string, source struct<platform: string, original_filename: string, exported_on_raw: string>"


def prepared(spark: SparkSession, platform, folder: str, threshold: float = messages.EMPTY) -> DataFrame:
    """The folder's conversations with emptiness, fingerprint and names, computed once."""
    rows = messages.with_emptiness(registry.parse_folder(spark, platform, folder), threshold)
    rows = rows.withColumn("fingerprint", diff.fingerprint_of(F.col("chat_messages")))
    return kept(mapping.with_stems(rows))


def markdown(conversations: DataFrame, **options) -> DataFrame:
    """(conv_ord, md)."""
    rows = messages_of(conversations, "conv_ord").withColumn("text", messages.visible_text("text", "content"))
    return render.render(rows, conversations.select("conv_ord", "name"), "conv_ord", **options)


def _write_parts(spark: SparkSession, docs: DataFrame, folder: str, per_part: int) -> DataFrame:
    """docs(stem, src_name, text) split into files; the whole folder is made anew."""
    split = kept(parts.split(docs, per_part, "stem"))
    sinks.delete(sinks.listed(spark, folder), folder)
    shutil.rmtree(folder, ignore_errors=True)
    sinks.write_texts(split, folder)
    return split


def _write_zips(split: DataFrame, folder: str, target: int, overflow: int) -> list:
    packed = kept(batches.pack(batches.group_by_stem(split.select("file_name")), target, overflow))
    sizes = split.select("file_name", F.octet_length("text").alias("size"))
    names = batches.batch_infos(sizes, packed).select("batch_no", "zip_name")
    rows = packed.select("batch_no", "stem", F.explode("files").alias("file_name")).join(names, "batch_no").join(split.select("file_name", "text"), "file_name")
    return sinks.write_zips(rows, folder)


def full_export(spark: SparkSession, platform, raw: str, base: str, per_part: int = 25, skip_empty: bool = True, target: int = 100, overflow: int = 20, dedupe: bool = True, shift: bool = False, safe: bool = True) -> dict:
    """All six stages; the counters that the last ones report. Writes no snapshot."""
    lay = Layout(base)
    convs = prepared(spark, platform, raw)
    n = convs.count()
    live = convs.where("not is_empty") if skip_empty else convs
    saved = sinks.write_conversations(live.withColumn("file_name", F.concat("old_stem", F.lit(".json"))), lay.split_json)
    md = kept(live.select("conv_ord", "old_stem").join(markdown(live, dedupe=dedupe, shift=shift, safe=safe), "conv_ord"))
    sinks.write_texts(md.select(F.concat("old_stem", F.lit(".md")).alias("file_name"), F.col("md").alias("text")), lay.notion_md)
    named = kept(mapping.resolved(live.select("conv_ord", "uuid", "name", "created_at", "stem", "old_stem")))
    table = mapping.mapping(named)
    sinks.write_mapping(table.orderBy("conv_ord"), lay.filename_mapping_csv, mapping.COLUMNS)
    # of rows with one name (one id twice) the last stays
    last = named.groupBy("final_stem").agg(F.max("conv_ord").alias("conv_ord"))
    docs = last.join(md, "conv_ord").select(F.col("final_stem").alias("stem"), F.concat("final_stem", F.lit(".md")).alias("src_name"), F.col("md").alias("text"))
    sinks.write_texts(docs.select(F.col("src_name").alias("file_name"), "text"), lay.notion_md_renamed)
    split = _write_parts(spark, docs, lay.notion_md_split, per_part)
    infos = _write_zips(split, lay.zip_batches, target, overflow)
    collisions = named.agg(F.coalesce(F.sum("n_collisions"), F.lit(0))).first()[0]
    return dict(n_conversations=n, n_saved=saved, n_skipped=n - saved, n_renamed=named.count(), n_collisions=collisions, n_zip_batches=len(infos), zip_infos=infos, mapping_csv=lay.filename_mapping_csv)


def read_snapshot(spark: SparkSession, lay: Layout) -> DataFrame:
    """The snapshot table; where there is none yet, a snapshot in JSON, or nothing."""
    if os.path.exists(lay.snapshot_table):
        return spark.read.schema(SNAPSHOT).parquet(lay.snapshot_table)
    if os.path.exists(lay.snapshot_path):
        return read_snapshot_json(spark, lay.snapshot_path)
    return spark.createDataFrame([], SNAPSHOT)


def read_snapshot_json(spark: SparkSession, path: str) -> DataFrame:
    """The records of a snapshot in JSON; without `records` none."""
    record = "struct<name: string, updated_at: string, fingerprint: array<string>, _source: struct<platform: string, original_filename: string, exported_on_raw: string>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"struct<records: map<string, {record}>>")["records"]).alias("uuid", "r"))
    at = lambda i: F.coalesce(F.get("r.fingerprint", F.lit(i)), F.lit(""))
    return rows.select("uuid", F.coalesce("r.name", F.lit("")).alias("name"), at(0).alias("updated_at"), at(1).alias("fingerprint"), F.col("r._source").alias("source"))


def write_snapshot_json(rows: DataFrame, path: str, saved_at: str = "") -> None:
    """A snapshot in JSON, its rows streamed through the driver."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write('{"saved_at": ' + json.dumps(saved_at) + ', "records": {')
        for i, r in enumerate(rows.select("uuid", "name", "updated_at", "fingerprint", "source").toLocalIterator()):
            source = {k: v for k, v in (r.source.asDict() if r.source else {}).items() if v is not None}
            record = {"name": r.name, "updated_at": r.updated_at, "fingerprint": [r.updated_at or "", r.fingerprint], "_source": source}
            f.write(("," if i else "") + "\n" + json.dumps(r.uuid, ensure_ascii=False) + ": " + json.dumps(record, ensure_ascii=False))
        f.write("\n}}\n")
    os.replace(f"{path}.part", path)


def write_snapshot(rows: DataFrame, lay: Layout) -> None:
    """The new table takes the old one's place once it is whole."""
    new = f"{lay.snapshot_table}.{uuids.uuid4().hex}"
    rows.write.parquet(new)
    old = f"{new}.old"
    if os.path.exists(lay.snapshot_table):
        os.replace(lay.snapshot_table, old)
    os.replace(new, lay.snapshot_table)
    shutil.rmtree(old, ignore_errors=True)


def _purge(spark: SparkSession, folder: str, ids: DataFrame) -> None:
    """Remove the numbered files of ids(uuid); any number of digits."""
    names = kept(sinks.listed(spark, folder))
    uuid = F.regexp_extract("file_name", r"\A[0-9]{4,}_(.+?)(?:\.|\z)", 1)
    sinks.delete(names.join(ids.where("uuid <> ''").select("uuid").distinct(), uuid == F.col("uuid"), "left_semi"), folder)


def incremental_export(spark: SparkSession, platform, raw: str, base: str, per_part: int = 25, skip_empty: bool = True, zip_changed: bool = False, target: int = 100, overflow: int = 20, **options) -> dict:
    """Regenerate new and updated conversations only, then split all anew; the counts by status.

    Two deliberate differences: old readable files are found by the whole id through the mapping table, and the
    split folder holds no parts of names that are gone. `zip_changed` packs the changed conversations' parts.
    """
    lay = Layout(base)
    convs = prepared(spark, platform, raw)
    status = kept(diff.classified(convs, read_snapshot(spark, lay), skip_empty))
    counts = diff.counts(status).first().asDict()
    changed = convs.join(status.where("status in ('new', 'updated') and conv_ord >= 0").select("conv_ord"), "conv_ord", "left_semi")
    for folder in (lay.split_json, lay.notion_md):
        _purge(spark, folder, changed.select("uuid"))
    sinks.write_conversations(changed.withColumn("file_name", F.concat("old_stem", F.lit(".json"))), lay.split_json)
    md = kept(changed.select("conv_ord", "uuid", "old_stem", "stem", "name", "created_at").join(markdown(changed, **options), "conv_ord"))
    sinks.write_texts(md.select(F.concat("old_stem", F.lit(".md")).alias("file_name"), F.col("md").alias("text")), lay.notion_md)
    write_snapshot(diff.snapshot(convs, skip_empty), lay)

    old = kept(sinks.read_mapping(spark, lay.filename_mapping_csv, mapping.COLUMNS))
    new = md.where("uuid <> ''").withColumn("final_stem", F.col("stem"))
    rows = kept(mapping.upserted(old, mapping.mapping(new), convs.select("conv_ord", "uuid")))
    gone = old.join(new.select(F.col("uuid").alias("conv_id")), "conv_id", "left_semi").select(F.col("new_filename").alias("file_name")).distinct()
    sinks.delete(gone, lay.notion_md_renamed)
    sinks.write_mapping(rows.orderBy("place"), lay.filename_mapping_csv, mapping.COLUMNS)
    n = sinks.write_texts(new.select(F.concat("final_stem", F.lit(".md")).alias("file_name"), F.col("md").alias("text")), lay.notion_md_renamed)
    docs = files.whole_texts(spark, lay.notion_md_renamed, ".md")
    docs = docs.select(F.regexp_replace("file_name", r"\.md\z", "").alias("stem"), F.col("file_name").alias("src_name"), F.col("value").alias("text"))
    split = _write_parts(spark, docs, lay.notion_md_split, per_part)
    out = counts | {"n_renamed": n, "mapping_csv": lay.filename_mapping_csv}
    if zip_changed:
        mine = split.join(new.select("stem"), "stem", "left_semi")
        out["zip_infos"] = _write_zips(kept(mine), lay.zip_batches_diff, target, overflow)
    return out


def clean_folder(spark: SparkSession, folder: str) -> dict:
    """Clean a folder's Markdown files in place; only changed ones are written."""
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    texts = files.with_contents(files.listed(spark, folder, ".md", hidden=True), folder, strict=True)
    done = kept(render.clean_all(texts.select("file_name", F.col("value").alias("text")), "file_name"))
    sinks.write_texts(done.where("changed"), folder)
    return {k: v or 0 for k, v in render.clean_totals(done).first().asDict().items()}


__all__ = ["clean_folder", "full_export", "incremental_export", "markdown", "prepared", "read_snapshot", "read_snapshot_json", "write_snapshot", "write_snapshot_json"]
