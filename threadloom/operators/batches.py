"""Files grouped by conversation and packed, in order, into upload batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import original_stem

TARGET, OVERFLOW = 100, 20


def group_by_stem(files: DataFrame) -> DataFrame:
    """(stem, files, n) from rows(file_name)."""
    return files.groupBy(original_stem(F.col("file_name")).alias("stem")).agg(F.sort_array(F.collect_list("file_name")).alias("files"), F.count(F.lit(1)).alias("n"))


def pack(groups: DataFrame, target: int = TARGET, overflow: int = OVERFLOW, per: int = 20_000) -> DataFrame:
    """groups(stem, n) with batch_no from 1, in the order of stems.

    Next-fit depends on all earlier groups. Only (stem, n) pairs are folded, one row per conversation; they are
    first reduced, in ranges of stems, to those that open a batch for each possible fill at the range's begin, so
    ranges are folded in parallel and chained through a table of target + overflow + 1 states a range.
    """
    from ..plans.tables import kept

    cap = target + overflow
    groups = kept(groups)
    total = groups.count()
    ranges = max(1, -(-total // per))
    dealt = groups.select("stem", F.col("n").cast("int").alias("n")).repartitionByRange(ranges, "stem").sortWithinPartitions("stem")
    dealt = dealt.withColumn("range", F.spark_partition_id())
    if ranges > 1:
        dealt = kept(dealt).repartition(ranges, "range").sortWithinPartitions("range", "stem")

    def fold(count: int, sizes, out=None):
        """The fill after the sizes, and how many batches they close; a fill of 0 is an empty bin."""
        closed = 0
        for n in sizes:
            if n > cap:
                closed += (count > 0) + 1
                count = 0
                if out is not None:
                    out.append(closed - 1)
                continue
            if count and count + n > cap:
                closed, count = closed + 1, 0
            count += n
            if out is not None:
                out.append(closed)
        return count, closed

    def by_range(batches):
        """(range, stems, sizes) of the ranges of one task."""
        at, stems, sizes = None, [], []
        for b in batches:
            for stem, n, r in zip(*(c.to_pylist() for c in b.columns)):
                if r != at:
                    if stems:
                        yield at, stems, sizes
                    at, stems, sizes = r, [], []
                stems.append(stem)
                sizes.append(n)
        if stems:
            yield at, stems, sizes

    def ends(batches):
        import pyarrow as pa

        for at, _, sizes in by_range(batches):
            got = [fold(c, sizes) for c in range(cap + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([[g[0] for g in got]], pa.list_(pa.int32())), pa.array([[g[1] for g in got]], pa.list_(pa.int64()))], ["range", "fill", "closed"])

    start, fill, before = {}, 0, 0
    if ranges > 1:
        for r in sorted(dealt.mapInArrow(ends, "range int, fill array<int>, closed array<long>").toLocalIterator(), key=lambda r: r["range"]):
            start[r["range"]] = (fill, before)
            fill, before = r["fill"][fill], before + r["closed"][fill]

    def number(batches):
        import pyarrow as pa

        for at, stems, sizes in by_range(batches):
            count, closed = start.get(at, (0, 0))
            out: list[int] = []
            fold(count, sizes, out)
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([closed + x + 1 for x in out], pa.int64())], ["stem", "batch_no"])

    numbered = dealt.mapInArrow(number, "stem string, batch_no long")
    return groups.join(numbered, "stem")


def batch_infos(files: DataFrame, packed: DataFrame) -> DataFrame:
    """(batch_no, zip_name, n_files, n_conversations, total_bytes) from files(file_name, size) and packed groups(stem, files, n, batch_no)."""
    each = packed.select("batch_no", "stem", F.explode("files").alias("file_name")).join(files, "file_name")
    infos = each.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("stem").alias("n_conversations"), F.sum("size").alias("total_bytes"))
    named = infos.crossJoin(F.broadcast(infos.agg(F.max("batch_no").alias("n_batches"))))  # one row
    digits = F.greatest(F.lit(2), F.length(F.col("n_batches").cast("string")))
    number = F.lpad(F.col("batch_no").cast("string"), digits, F.lit("0"))
    name = F.concat(F.lit("notion_md_batch_"), number, F.lit("_"), F.format_string("%03dfiles.zip", "n_files"))
    return named.select("batch_no", name.alias("zip_name"), "n_files", "n_conversations", "total_bytes")
