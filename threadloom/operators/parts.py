"""Markdown files split into parts of a fixed number of labelled blocks. All within a row; parts are exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import join_lines, positions, rstrip, splitlines, SPACE

PER_PART = 25
_BOUNDARY = rf"\A(?:#{{1,6}}[ \t]+|- )pcp_(\p{{Nd}}{{3}}(?:_\p{{Nd}}{{3}})*)[{SPACE}]*\z"


def parsed(files: DataFrame, text: str = "text") -> DataFrame:
    """files with `lines`, and `at`: the places of block boundaries."""
    rows = files.withColumn("lines", splitlines(text))
    return rows.withColumn("at", positions(F.col("lines"), lambda x: x.rlike(_BOUNDARY)))


def blocks(files: DataFrame, *columns: str) -> DataFrame:
    """A row a block: (columns, block_ord, label, first_num, n_lines); block_ord from 0."""
    rows = parsed(files).select(*columns, "lines", "at", F.posexplode("at").alias("block_ord", "begin"))
    end = F.coalesce(F.get("at", F.col("block_ord") + 1), F.size("lines"))
    label = F.regexp_extract(F.get("lines", F.col("begin")), _BOUNDARY, 1)
    return rows.select(*columns, "block_ord", label.alias("label"), _number(label).alias("first_num"), (end - F.col("begin")).alias("n_lines"))


def _number(label: Column) -> Column:
    return F.split_part(label, F.lit("_"), F.lit(1)).cast("int")


def part_name(stem, idx, low, high) -> Column:
    return F.format_string("%s__part%02d_pcp%03d-%03d.md", stem, idx, low, high)


def split(files: DataFrame, per_part: int = PER_PART, *columns: str) -> DataFrame:
    """(columns, part, n_parts, n_blocks, file_name, text) from files(stem, src_name, text); a file without blocks is one part as it is."""
    rows = parsed(files)
    n = F.size("at")
    total = F.greatest(F.ceil(n / per_part).cast("int"), F.lit(1))
    rows = rows.withColumn("n_parts", total).withColumn("part", F.explode(F.sequence(F.lit(1), total)))
    lo = (F.col("part") - 1) * per_part
    mine = F.slice("at", lo + 1, per_part)
    end_of = lambda k: F.coalesce(F.get("at", lo + k + 1), F.size("lines"))

    def block(begin, k):
        body = F.slice("lines", begin + 1, end_of(k) - begin)
        return F.when(F.element_at(body, -1) != "", F.concat(body, F.array(F.lit("")))).otherwise(body)

    numbers = F.transform(mine, lambda b: _number(F.regexp_extract(F.get("lines", b), _BOUNDARY, 1)))
    low, high = F.array_min(numbers), F.array_max(numbers)
    header = rstrip(join_lines(F.slice("lines", 1, F.get("at", F.lit(0)))))
    note = F.format_string("_(part %d / %d : pcp_%03d 〜 pcp_%03d, %d pcps, source: %s)_", "part", "n_parts", low, high, F.size(mine), "src_name")
    front = F.concat(F.when(header != "", F.array(header)).otherwise(F.array().cast("array<string>")), F.array(F.lit(""), note, F.lit("")))
    body = F.flatten(F.transform(mine, block))
    whole = F.concat(rstrip(join_lines(F.concat(front, body))), F.lit("\n"))
    some = F.size("at") > 0
    name = F.when(some, part_name(F.col("stem"), F.col("part"), low, high)).otherwise(F.concat("stem", F.lit(".md")))
    return rows.select(*columns, "part", "n_parts", F.size(mine).alias("n_blocks"), name.alias("file_name"), F.when(some, whole).otherwise(F.col("text")).alias("text"))
