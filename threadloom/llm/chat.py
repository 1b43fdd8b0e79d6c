"""Operator 9: chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, its reply alone under the loss mask. Turns
after the last reply make one more example without a target, so nothing of a conversation is lost. The examples of a
conversation are prefixes of one rendering, which is held once while they are written. That is quadratic in a
conversation's turns, as the expansion itself is; a conversation's last example holds all of it in one row, so a
conversation is no longer than a row may be.

`digests` reads the examples that `examples` makes, batch by batch in the same worker: the turns from each
conversation's last example, what is trained from every example's mask, and the lengths of all texts.

A turn is `[INST] text [/INST]` (user), `[SYS] text [/SYS]` (system), `[ANS] text </s>` (assistant) or
`[TURN "role"] text [/TURN]`; `<s>` begins an example. A control string inside a text gets a backslash before it, one
more than it has, and loses one on the way back; control strings of the template never follow a backslash.

Rows are ordered by turn, then role and text. Cases: null text is empty; a null role is written as null and read as
empty; null conv_ids are one conversation; null turns come first; repeated rows are turns; an empty table gives an
empty table; other columns, whatever their names, are ignored. A very long text or conversation is written whole.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean

BEGIN = "<s>"
#: role: (opening, closing)
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[ANS] ", " </s>")}
_CONTROL = r"\[/?(?:INST|SYS|ANS)\]|\[/?TURN|</?s>"
_PLAIN = re.compile(_CONTROL)
_ESCAPED = re.compile(r"\\(" + _CONTROL + ")")
_ANY = re.compile(r"[\[<]")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: "\\" + m.group(), text) if _ANY.search(text) else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn's part of the output, and where its text begins and ends there."""
    before, after = MARKS.get(role) or (f"[TURN {escape(json.dumps(role))}] ", " [/TURN]")
    body = escape(text or "")
    return before + body + after, len(before), len(before) + len(body)


def read(text: str, at: int) -> tuple[str, int, int, int]:
    """The turn that begins at `at`: role, begin and end of its body, and where the next begins."""
    for role, (before, after) in MARKS.items():
        if text.startswith(before, at):
            end = text.index(after, at + len(before))
            return role, at + len(before), end, end + len(after)
    if not text.startswith("[TURN ", at):
        raise ValueError("no turn begins here")
    cut = text.index('"] ', at) + 1 if text.startswith('[TURN "', at) else text.index("] ", at)
    while True:
        try:
            role = json.loads(unescape(text[at + 6 : cut]))
            break
        except ValueError:
            cut = text.index('"] ', cut) + 1
    end = text.index(" [/TURN]", cut + 2)
    return role or "", cut + 2, end, end + 8


def read_all(text: str) -> list[tuple]:
    """The turns of an example."""
    if not text.startswith(BEGIN):
        raise ValueError("no example begins here")
    at, out = len(BEGIN), []
    while at < len(text):
        role, a, b, at = read(text, at)
        out.append((role, unescape(text[a:b])))
    return out


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


_EXAMPLE = ["conv_id", "example", "text", "loss_start", "loss_end"]
#: Characters of examples that one batch holds, about.
_BATCH = 8_000_000


def _expand(batches):
    """Batches of examples from batches of a conversation's turns in order."""
    import pyarrow as pa

    kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()
    conv, held, made, pending, out, size = object(), "", 0, False, [], 0

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], _EXAMPLE)

    for batch in batches:
        for c, _, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            if c != conv:
                if pending:
                    out.append((conv, made, held, len(held), len(held)))
                conv, held, made = c, BEGIN, 0
            part, a, b = render(role, text)
            a, b, held = a + len(held), b + len(held), held + part
            pending = role != "assistant"
            if not pending:
                out.append((c, made, held, a, b))
                made += 1
                size += len(held)
                if size > _BATCH:
                    yield batch_of(out)
                    out, size = [], 0
    if pending:
        out.append((conv, made, held, len(held), len(held)))
    if out:
        yield batch_of(out)


def _read_back(examples):
    """Batches of digests, one row a conversation, from batches of its examples in order."""
    import pyarrow as pa

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    conv, last, loss, chars, total, out = object(), None, None, 0, 0, []

    def end():
        turns = read_all(last)
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
        return conv, len(turns), digest, chars, loss.hexdigest(), total

    for batch in examples:
        for c, _, text, a, b in zip(*(x.to_pylist() for x in batch.columns)):
            if c != conv:
                if last is not None:
                    out.append(end())
                conv, loss, chars, total = c, hashlib.sha256(), 0, 0
            last, trained = text, unescape(text[a:b])
            loss.update(trained.encode())
            chars += len(trained)
            total += len(text)
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
            out = []
    if last is not None:
        out.append(end())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): the examples, with their masks in code points (equal where nothing is trained)."""
    return _sorted(conversations).mapInArrow(lean(_expand), "conv_id long, example long, text string, loss_start long, loss_end long")


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, what is under the loss mask, and the code points of all examples."""
    return _sorted(conversations).mapInArrow(lean(lambda batches: _read_back(_expand(batches))), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(rows.unionByName(more))


ORACLE = """
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, regexp_replace(text, '(\\[/?(?:INST|SYS|ANS)\\]|\\[/?TURN|</?s>)', '\\\\\\1', 'g') AS body FROM c
), r AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 11 END + length(body) AS size FROM p
), s AS (
  SELECT *, 3 + sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR back = 1), 0)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
