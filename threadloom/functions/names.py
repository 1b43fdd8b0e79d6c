"""Column expressions for file names, dates, sizes and hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import SPACE, or_else, replace

MAX_TITLE = 80
_DAY = r"\A(\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2})"


def nfc(c, any_unicode: bool = True) -> Column:
    """The composed form (an Arrow UDF, as Spark has none); titles known to be ASCII can go without."""

    def composed(titles: pd.Series) -> pd.Series:
        import unicodedata

        return titles.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(composed, "string")(c) if any_unicode else c


def sanitize_title(c, max_len: int = MAX_TITLE, any_unicode: bool = True) -> Column:
    """A title as a part of a file name."""
    t = nfc(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), any_unicode)
    t = replace(t, r'[/\\:*?"<>|\x00-\x1F\x7F]', "_")
    t = replace(replace(t, f"[{SPACE}]+", "_"), "_+", "_")
    t = replace(replace(t, rf"[{SPACE}.]+\z", ""), r"\A_+|_+\z", "")
    t = F.when(F.length(t) > max_len, replace(F.substring(t, 1, max_len), r"_+\z", "")).otherwise(t)
    return or_else(t, "untitled")


def day_of(c) -> Column:
    """The text's leading date, else the UTC day of a positive number of seconds, else null."""
    text = F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))
    number = text.try_cast("double")
    day = F.when((number > 0) & (number < 253402300800), F.date_format(F.timestamp_micros(F.floor(number * 1000000)), "yyyy-MM-dd"))
    return F.coalesce(F.nullif(F.regexp_extract(text, _DAY, 1), F.lit("")), day)


def date_prefix(original_filename, created_at, updated_at) -> Column:
    first = F.nullif(F.regexp_extract(F.coalesce(original_filename, F.lit("")), _DAY, 1), F.lit(""))
    return F.coalesce(first, day_of(created_at), day_of(updated_at), F.lit("undated"))


def short_id(c, length: int = 8) -> Column:
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    head = F.split_part(c, F.lit("-"), F.lit(1))
    body = F.when(F.length(head) >= length, head).otherwise(F.replace(c, F.lit("-"), F.lit("")))
    return F.when(c == "", "noid").otherwise(or_else(F.substring(body, 1, length), "noid"))


def readable_stem(name, uuid, original_filename, created_at, updated_at, any_unicode: bool = True) -> Column:
    return F.concat_ws("__", date_prefix(original_filename, created_at, updated_at), sanitize_title(name, any_unicode=any_unicode), short_id(uuid))


def stem_of(name) -> Column:
    """A file name without its last suffix."""
    return replace(name, r"(?s)(?<=.)\.[^./]+\z", "")


def is_legacy(name) -> Column:
    return stem_of(name).rlike(r"\A\p{Nd}{4}_[\-a-f0-9]{8,}\z")


def numbered_stem(ord_, uuid) -> Column:
    return F.format_string("%04d_%s", ord_, or_else(uuid, "noid"))


def original_stem(name) -> Column:
    """The stem that a part's file name was made from; other names' own stem."""
    stem = stem_of(name)
    return or_else(F.regexp_extract(stem, r"\A((?s).+?)__part\p{Nd}+_pcp\p{Nd}+-\p{Nd}+\z", 1), stem)


def text_sha1(c) -> Column:
    return F.sha1(c)


def format_size(n) -> Column:
    """A whole number of bytes in the largest unit that leaves it below 1024, with one decimal, ties to the even one."""
    n = (F.col(n) if isinstance(n, str) else n).cast("decimal(30,0)")

    def shown(k: int, unit: str) -> Column:
        by = F.lit(1024**k).cast("decimal(20,0)")
        rest = (n * 10) % by
        tenths = ((n * 10 - rest) / by).cast("long")
        tenths = tenths + ((rest * 2 > by) | ((rest * 2 == by) & (tenths % 2 == 1))).cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))

    out = F.when(n < 1024, shown(0, "B"))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (k + 1), shown(k, unit))
    return out.otherwise(shown(4, "TB"))
