"""Column expressions on Markdown texts. All work within a row, so none needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import SPACE, is_blank, join_lines, let, positions, replace, rstrip, segmented, splitlines, strip, without

LABEL = r"pcp_(\p{Nd}{3}(?:_\p{Nd}{3})*)"
DEEPEST = 3
UNSUPPORTED = "This block is not supported"
_FENCE = rf"\A[{SPACE}]*(?:```|~~~)"
_BACKTICKS = rf"\A[{SPACE}]*```"
_OPEN, _CLOSE = "\uFDD0", "\uFDD1"


def label_of(c) -> Column:
    """The first label in the text, or null."""
    return F.nullif(F.regexp_extract(c, f"(?i){LABEL}", 1), F.lit(""))


def shift_headings(c, floor_level: int = 2) -> Column:
    """Headings outside code moved down to begin at `floor_level`; below the deepest level they turn bold."""
    form = r"\A(#{1,6})[ \t]+((?s).*)\z"

    def heading(x):
        level = F.length(F.regexp_extract(x, form, 1)) + (floor_level - 1)
        content = F.regexp_extract(x, form, 2)
        bold = let(strip(content), lambda t: F.when(t != "", F.concat(F.lit("**"), t, F.lit("**"))).otherwise(""))
        return F.when(level <= DEEPEST, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), content)).otherwise(bold)

    def all_lines(lines):
        fences = positions(lines, lambda x: x.rlike(_FENCE))
        return let(fences, lambda f: segmented(lines, f, lambda x, _, k: F.when(x.rlike(form) & (k % 2 == 0), heading(x)).otherwise(x)))

    return join_lines(let(splitlines(c), all_lines))


def _unsupported_blocks(lines: Column) -> Column:
    """(first, last) places of fenced blocks of at most three lines that hold the marker."""
    holds = lambda b: F.exists(F.slice(lines, b["a"] + 2, F.greatest(b["b"] - b["a"] - 1, F.lit(0))), lambda x: F.contains(x, F.lit(UNSUPPORTED)))

    def found(fences):
        starts = F.filter(fences, lambda _, k: k % 2 == 0)
        blocks = F.transform(starts, lambda s, k: F.struct(s.alias("a"), F.coalesce(F.get(fences, k * 2 + 1), F.size(lines)).alias("b")))
        return F.filter(blocks, lambda b: (b["b"] - b["a"] <= 4) & holds(b))

    return let(positions(lines, lambda x: x.rlike(_BACKTICKS)), found)


def count_unsupported(c) -> Column:
    return let(splitlines(c), lambda lines: F.size(_unsupported_blocks(lines))).cast("long")


def without_unsupported(c) -> Column:
    def rest(lines):
        return let(_unsupported_blocks(lines), lambda blocks: without(lines, blocks))

    return join_lines(let(splitlines(c), rest))


def count_block_math(c) -> Column:
    return F.regexp_count(c, F.lit(r"(?s)[$]{2}.+?[$]{2}")).cast("long")


def math_to_code(c) -> Column:
    """`$$ x $$` as inline code, its content stripped."""
    marked = replace(c, r"(?s)[$]{2}(.+?)[$]{2}", _OPEN + "$1" + _CLOSE)
    return replace(replace(marked, f"{_OPEN}[{SPACE}]*", "`"), f"[{SPACE}]*{_CLOSE}", "`")


def collapse_blanks(c) -> Column:
    return replace(c, "\n\n\n+", "\n\n")


def space_rules(c) -> Column:
    """An empty line between a horizontal rule and any text beside it."""
    rule = lambda x: x.rlike(f"\\A[{SPACE}]*---[{SPACE}]*\\z")

    def spaced(lines):
        def change(x, i):
            before = F.get(lines, i - 1)
            gap = (i > 0) & (rule(before) | rule(x)) & ~is_blank(before) & ~is_blank(x)
            return F.when(gap, F.array(F.lit(""), x)).otherwise(F.array(x))

        return F.flatten(F.transform(lines, change))

    return join_lines(let(splitlines(c), spaced))


def cleaned(c, remove_unsupported=True, convert_block_math=True, normalize_blanks=True) -> Column:
    """struct<text, unsupported_removed, block_math_converted>; the text ends in one line end."""
    zero = F.lit(0).cast("long")

    def end(text, removed, converted):
        if normalize_blanks:
            text = collapse_blanks(space_rules(collapse_blanks(text)))
        return F.struct(F.concat(rstrip(text), F.lit("\n")).alias("text"), removed.alias("unsupported_removed"), converted.alias("block_math_converted"))

    def math(text, removed):
        if not convert_block_math:
            return end(text, removed, zero)
        return let(text, lambda t: end(math_to_code(t), removed, count_block_math(t)))

    def first(lines):
        def rest(blocks):
            return math(join_lines(without(lines, blocks)), F.size(blocks).cast("long"))

        return let(_unsupported_blocks(lines), rest)

    text = F.col(c) if isinstance(c, str) else c
    return let(splitlines(text), first) if remove_unsupported else math(text, zero)
