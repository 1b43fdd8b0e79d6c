"""Whole-text scans with names, and the order of what they hold.

Spark's file sources deal about 30 small files to a task, hold every name on the driver and leave empty files out. So a
folder that tasks can open is listed by one of them, which deals its files to shares, and read by a task a share.
"""

from __future__ import annotations

import os
import re
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..shipping import ship

#: A share ends with so many bytes or files.
SHARE_BYTES, SHARE_FILES = 4 << 20, 1_000
#: A task passes on so many bytes at once; a longer file goes alone, mapped instead of read.
AT_ONCE = 2 << 20


def _path(folder: str) -> str | None:
    """The folder (or one file) as a path that Python opens; None for other file systems, patterns and what isn't there."""
    path = re.sub(r"\Afile:/*", "/", folder)
    return os.path.abspath(path) if os.path.exists(path) else None


def _names(path: str, suffix: str, hidden: bool, form: str):
    """(name, bytes) of the folder's own files, in the order of the file system."""
    whole, folder = re.compile(form, re.DOTALL), os.path.isdir(path)
    with os.scandir(path if folder else os.path.dirname(path)) as found:
        for x in found:
            wanted = x.name.endswith(suffix) and (hidden or x.name[0] not in "._") and whole.fullmatch(x.name)
            if wanted and (folder or x.path == path) and x.is_file():
                yield x.name, x.stat().st_size


def listed(spark: SparkSession, folder: str, suffix: str = "", hidden: bool = False, form: str = ".*") -> DataFrame:
    """(file_name, share) of a folder's own files, empty ones too, whose names have the suffix and match the form; without `hidden` none that begins with _ or a point."""
    from ..plans.tables import kept

    ship()
    path = _path(folder)
    if path is None:
        rows = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_name").alias("file_name"))
        rows = rows.select(F.url_decode(F.replace("file_name", F.lit("+"), F.lit("%2B"))).alias("file_name"))
        return kept(rows.where(F.endswith("file_name", F.lit(suffix)) & F.col("file_name").rlike(rf"(?s)\A(?:{form})\z")).withColumn("share", F.spark_partition_id()))

    def run(batches):
        import pyarrow as pa

        def rows(names, shares):
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.int32())], ["file_name", "share"])

        for _ in batches:
            share, n, held, names, shares = 0, 0, 0, [], []
            for name, size in _names(path, suffix, hidden, form):
                if n and (n >= SHARE_FILES or held + size > SHARE_BYTES):
                    share, n, held = share + 1, 0, 0
                n, held = n + 1, held + size
                names.append(name)
                shares.append(share)
                if len(names) == 10_000:
                    yield rows(names, shares)
                    names, shares = [], []
            yield rows(names, shares)

    return kept(spark.range(0, 1, 1, 1).mapInArrow(run, "file_name string, share int"))


def dealt(rows: DataFrame) -> DataFrame:
    """rows(share, …) with a task a share."""
    most = rows.agg(F.max("share")).first()[0]
    return rows.repartitionById(1 + (most or 0), F.col("share"))


def with_contents(rows: DataFrame, folder: str, column: str = "value", strict: bool = False) -> DataFrame:
    """rows(file_name, share, …) with the files' contents: as text in `value`, as bytes in another column. `strict` makes it an error if one isn't UTF-8."""
    path = _path(folder)
    root = path if os.path.isdir(path) else os.path.dirname(path)
    text = column == "value"
    schema = StructType([*rows.schema.fields, StructField(column, StringType() if text else BinaryType())])

    def run(batches):
        import pyarrow as pa

        def joined(some, lengths, data):
            ends = pa.array([0, *accumulate(lengths)], pa.int32())
            values = pa.Array.from_buffers(pa.string() if text else pa.binary(), len(ends) - 1, [None, ends.buffers()[1], pa.py_buffer(data)])
            if strict:
                values.validate(full=True)
            return pa.RecordBatch.from_arrays([*some.columns, values], [*some.schema.names, column])

        for b in batches:
            begin, held, parts = 0, 0, []
            for i, name in enumerate(b.column("file_name").to_pylist()):
                full = os.path.join(root, name)
                size = os.path.getsize(full)
                if parts and held + size > AT_ONCE:
                    yield joined(b.slice(begin, i - begin), map(len, parts), b"".join(parts))
                    begin, held, parts = i, 0, []
                if size > AT_ONCE:
                    with pa.memory_map(full) as f:
                        data = f.read_buffer()
                    yield joined(b.slice(i, 1), [data.size], data)
                    begin = i + 1
                    continue
                with open(full, "rb") as f:
                    parts.append(f.read())
                held += len(parts[-1])
            if parts:
                yield joined(b.slice(begin), map(len, parts), b"".join(parts))

    return dealt(rows).mapInArrow(run, schema)


def whole_texts(spark: SparkSession, folder: str, suffix: str = "", strip_bom: bool = False) -> DataFrame:
    """(file_name, value) of the folder's own files with the suffix; names that begin with _ or . are left out. A missing folder is an error.

    Of a folder that only Spark can open (another file system, a pattern) empty files are left out.
    """
    if _path(folder):
        rows = with_contents(listed(spark, folder, suffix), folder).select("file_name", "value")
    else:
        rows = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
        rows = rows.withColumn("file_name", F.url_decode(F.replace("file_name", F.lit("+"), F.lit("%2B"))))
        rows = rows.where(F.endswith("file_name", F.lit(suffix)) & ~F.startswith("file_name", F.lit("_")))
    return _without_bom(rows) if strip_bom else rows


def starts(sizes: DataFrame, per: int = 50_000) -> DataFrame:
    """sizes(file_name, m, …) with `start` for m: how many the files with smaller names have in all.

    Files are ordered in ranges of about `per` names; only the ranges' totals, one row each, are chained.
    """
    from ..plans.tables import kept

    sizes = kept(sizes)
    ranges = 1 + sizes.count() // per
    sizes = kept(sizes.repartitionByRange(ranges, "file_name").withColumn("range", F.spark_partition_id()))
    totals = {r["range"]: r.m for r in sizes.groupBy("range").agg(F.sum("m").alias("m")).collect()}
    ahead, chained = 0, []
    for r in sorted(totals):
        chained.append((r, ahead))
        ahead += totals[r]
    chained = sizes.sparkSession.createDataFrame(chained, "range int, ahead long")
    before = W.partitionBy("range").orderBy("file_name").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("m").over(before), F.lit(0))
    return sizes.join(F.broadcast(chained), "range").withColumn("start", start.cast("long")).drop("range", "ahead", "m")


def numbered(rows: DataFrame, per: int = 50_000) -> DataFrame:
    """rows(file_name, file_pos, …) with conv_ord: by file name, then place in the file."""
    sizes = rows.groupBy("file_name").agg((F.max("file_pos") + 1).cast("long").alias("m"))
    return rows.join(starts(sizes, per), "file_name").withColumn("conv_ord", (F.col("start") + F.col("file_pos")).cast("long")).drop("start")


def _items(single: bool):
    head = F.substring(F.regexp_replace("value", r"\A\s+", ""), 1, 1)
    many = F.from_json("value", "array<string>")
    wrong = F.raise_error(F.concat(F.lit("not an array of conversations: "), "file_name"))
    items = F.when(head == "[", many)
    if single:
        items = items.when(head == "{", F.array("value"))
    return items.otherwise(wrong.cast("array<string>"))


def elements(files: DataFrame, single: bool, *columns: str) -> DataFrame:
    """(file_name, columns, file_pos, raw) of the JSON arrays in files; `single` takes an object as an array of one."""
    return files.select("file_name", *columns, F.posexplode(_items(single)).alias("file_pos", "raw"))


def _without_bom(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.regexp_replace("value", r"\A\x{FEFF}", ""))


def numbered_texts(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(file_name, value, conv_ord) of files that hold one conversation each: their names are numbered before the texts are read, so no text is moved."""
    if not _path(folder):
        return numbered(whole_texts(spark, folder, suffix).withColumn("file_pos", F.lit(0)))
    named = starts(listed(spark, folder, suffix).withColumn("m", F.lit(1)))
    return with_contents(named, folder).select("file_name", "value", F.col("start").alias("conv_ord"))


def numbered_elements(spark: SparkSession, folder: str, suffix: str, single: bool) -> DataFrame:
    """(file_name, file_pos, raw, conv_ord) of the files' JSON arrays. They are read twice, to count and to take their elements, and not moved."""
    if not _path(folder):
        return numbered(elements(whole_texts(spark, folder, suffix, True), single))
    texts = lambda rows: _without_bom(with_contents(rows, folder))
    counted = texts(listed(spark, folder, suffix)).select("file_name", "share", F.coalesce(F.size(_items(single)), F.lit(0)).alias("m"))
    rows = elements(texts(starts(counted.withColumn("m", F.greatest("m", F.lit(0))))), single, "start")
    return rows.select("file_name", "file_pos", "raw", (F.col("start") + F.col("file_pos")).alias("conv_ord"))


def file_sha1(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file_name, sha1) of the folder's files, by their bytes; of empty ones too."""
    if _path(folder):
        form = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
        rows = with_contents(listed(spark, folder, form=form), folder, "content")
        return rows.select("file_name", F.sha1("content").alias("sha1"))
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("file_name"), F.sha1("content").alias("sha1"))
