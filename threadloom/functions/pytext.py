"""Column expressions for text as Python's str methods see it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that str.isspace accepts, as the inside of a Java character class.
SPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The line ends of str.splitlines.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"


def replace(c, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def strip(c) -> Column:
    return replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def rstrip(c) -> Column:
    return replace(c, rf"[{SPACE}]+\z", "")


def is_blank(c) -> Column:
    """Whether nothing but blanks is in it; null counts as blank."""
    return ~F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(rf"[^{SPACE}]")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def splitlines(c) -> Column:
    """The lines, without a last empty one; an empty text has none."""
    return let(F.split(c, LINE_END, -1), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def join_lines(lines) -> Column:
    return F.array_join(lines, "\n")


def or_else(c, default) -> Column:
    """c, or the default where c is null or empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def positions(lines: Column, test) -> Column:
    """The places, from 0, of the lines that pass the test, ascending."""
    marked = F.transform(lines, lambda x, i: F.when(test(x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def segmented(items: Column, places: Column, body) -> Column:
    """body(item, i, k) of every item, with k the number of the ascending places before i. Takes time in proportion to both."""

    def segment(k):
        begin = F.when(k > 0, F.get(places, k - 1) + 1).otherwise(F.lit(0))
        stop = F.coalesce(F.get(places, k) + 1, F.size(items))
        return let(begin, lambda b: F.transform(F.slice(items, b + 1, stop - b), lambda x, i: body(x, i + b, k)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), segment))


def without(items: Column, blocks: Column) -> Column:
    """items without those from place `a` to place `b` of each of the ascending blocks."""

    def gap(k):
        begin = F.when(k > 0, F.get(blocks, k - 1)["b"] + 1).otherwise(F.lit(0))
        stop = F.coalesce(F.get(blocks, k)["a"], F.size(items))
        return F.slice(items, begin + 1, F.greatest(stop - begin, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(blocks)), gap))
