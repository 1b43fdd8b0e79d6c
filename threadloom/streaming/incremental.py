"""Changes of a growing folder of exports, by Structured Streaming's file source.

Each micro-batch names new files; the folder's state is compared with the snapshot once a batch, so a batch that is
run again finds nothing changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.export import incremental_export


def watch(spark: SparkSession, platform, raw: str, base: str, checkpoint: str, done=None, **options):
    """A query over what is there now (trigger availableNow); `done` gets each batch's counts."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", False).load(raw)

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        result = incremental_export(spark, platform, raw, base, **options)
        if done:
            done(number, result)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
