"""Sinks for what needs a name of its own: one file a row, zip archives, a CSV table.

The tasks write to a path that all executors share. A file is written below its folder and renamed, so a task that is
run again leaves whole files.
"""

from __future__ import annotations

import csv
import json
import os
import shutil
import tempfile
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import files


@contextmanager
def _placing(folder: str):
    """A function (name, raw bytes) that puts a file into the folder. Tasks prepare files in folders of their own, as they would wait for each other in a shared one."""
    aside = tempfile.mkdtemp(prefix=".part-", dir=folder)

    def place(name: str, raw) -> None:
        part = os.path.join(aside, name)
        with open(part, "wb") as f:
            f.write(raw)
        os.replace(part, os.path.join(folder, name))

    try:
        yield place
    finally:
        shutil.rmtree(aside, ignore_errors=True)


def write_texts(rows: DataFrame, folder: str) -> int:
    """rows(file_name, text) as UTF-8 files, from the bytes of the batch; the number of rows."""
    ship()
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import pyarrow as pa

        with _placing(folder) as place:
            for b in batches:
                for name, text in zip(b.column(0), b.column(1)):
                    place(name.as_py(), text.as_buffer() or b"")
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select("file_name", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def as_json(conversation: dict) -> str:
    """A conversation as its JSON file has it: `_source` and the extras without what isn't there."""
    some = lambda d: {k: v for k, v in (d or {}).items() if v is not None}
    messages = [{**m, "content": m["content"], "extra": some(m["extra"])} for m in conversation["chat_messages"] or []]
    out = {k: conversation[k] for k in ("uuid", "name")} | {"chat_messages": messages} | {k: conversation[k] for k in ("created_at", "updated_at")}
    return json.dumps(out | {"_source": some(conversation["source"])}, ensure_ascii=False, indent=2)


def write_conversations(rows: DataFrame, folder: str) -> int:
    """rows(file_name, and a conversation's columns) as JSON files."""
    ship()
    columns = ["uuid", "name", "chat_messages", "created_at", "updated_at", "source"]
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import pyarrow as pa

        with _placing(folder) as place:
            for b in batches:
                for k in range(b.num_rows):  # one by one: as Python objects a whole batch takes many times its bytes
                    row = b.slice(k, 1).to_pylist()[0]
                    place(row["file_name"], as_json(row).encode())
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select("file_name", *columns).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_zips(rows: DataFrame, folder: str, compression_level: int = 6) -> list:
    """rows(batch_no, zip_name, stem, file_name, text) as archives; (zip_name, n_files, n_conversations, zip_size, total_bytes) of each."""
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import pyarrow as pa

        name, archive, n, total, stems, out = None, None, 0, 0, set(), []

        def close():
            archive.close()
            path = os.path.join(folder, name)
            os.replace(f"{path}.part", path)
            out.append((name, n, len(stems), os.path.getsize(path), total))

        for b in batches:
            for zip_name, stem, file_name, text in (map(lambda x: x.as_py(), row) for row in zip(*b.columns)):
                if zip_name != name:
                    if archive:
                        close()
                    name, n, total, stems = zip_name, 0, 0, set()
                    archive = zipfile.ZipFile(os.path.join(folder, f"{name}.part"), "w", zipfile.ZIP_DEFLATED, compresslevel=compression_level)
                raw = text.encode()
                archive.writestr(file_name, raw)
                n, total = n + 1, total + len(raw)
                stems.add(stem)
        if archive:
            close()
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["zip_name", "n_files", "n_conversations", "zip_size", "total_bytes"])

    dealt = rows.select("zip_name", "stem", "file_name", "text").repartition("zip_name").sortWithinPartitions("zip_name", "stem", "file_name")
    infos = dealt.mapInArrow(run, "zip_name string, n_files long, n_conversations long, zip_size long, total_bytes long")
    return sorted(infos.collect(), key=lambda r: r.zip_name)


def write_mapping(rows: DataFrame, path: str, columns: list[str]) -> int:
    """rows, already ordered, as a CSV table with a byte order mark; rows are streamed through the driver."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    n = 0
    with open(f"{path}.part", "w", newline="", encoding="utf-8-sig") as f:
        table = csv.writer(f)
        table.writerow(columns)
        for row in rows.select(*columns).toLocalIterator():
            table.writerow(row)
            n += 1
    os.replace(f"{path}.part", path)
    return n


def listed(spark, folder: str) -> DataFrame:
    """(file_name) of a folder's own files, empty ones too; none for a missing folder."""
    if not os.path.isdir(folder):
        return spark.createDataFrame([], "file_name string")
    return files.dealt(files.listed(spark, folder)).select("file_name")


def delete(rows: DataFrame, folder: str) -> int:
    """Remove the files that rows(file_name) name, by tasks; the number of rows. What isn't there is no error."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name in b.column(0).to_pylist():
                path = os.path.join(folder, name)
                if os.path.exists(path):
                    os.unlink(path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select("file_name").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_mapping(spark, path: str, columns: list[str]) -> DataFrame:
    """The table, with `ord` in its order."""
    schema = ", ".join(f"{c} string" for c in columns)
    if not os.path.exists(path):
        return spark.createDataFrame([], f"{schema}, ord long")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns], F.monotonically_increasing_id().alias("ord"))
