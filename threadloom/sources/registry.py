"""Readers by name: (spark, folder) -> conversations with the columns of schema.CONVERSATION."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import export_md, flat_json, tree_json

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {"chatgpt": tree_json.read, "claude": flat_json.read, "gemini": export_md.read}


def register(name: str, reader: Reader) -> None:
    _READERS[name] = reader


def reader(name: str | Reader) -> Reader:
    if callable(name):
        return name
    if name not in _READERS:
        raise KeyError(f"no reader is called {name}; there are {sorted(_READERS)}")
    return _READERS[name]


def parse_folder(spark: SparkSession, platform: str | Reader, folder: str) -> DataFrame:
    return reader(platform)(spark, folder)
