"""The exports of each platform: `platforms.chatgpt.full_export(spark, raw, base)`, and so on; `of(name)` for any reader that is registered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .plans import export
from .sources import registry


@dataclass(frozen=True)
class Platform:
    """A registered reader's name, and the workflows over its exports."""

    name: str

    def parse_folder(self, spark: SparkSession, folder: str) -> DataFrame:
        return registry.parse_folder(spark, self.name, folder)

    def full_export(self, spark: SparkSession, raw: str, base: str, **options) -> dict:
        return export.full_export(spark, self.name, raw, base, **options)

    def incremental_export(self, spark: SparkSession, raw: str, base: str, **options) -> dict:
        return export.incremental_export(spark, self.name, raw, base, **options)


def of(name: str) -> Platform:
    registry.reader(name)
    return Platform(name)


chatgpt, claude, gemini = map(Platform, ("chatgpt", "claude", "gemini"))
