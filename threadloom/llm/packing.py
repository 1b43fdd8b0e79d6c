"""Operator 5: best-fit packing of token sequences.

Bounded-space online best-fit: at most `open_bins` sequences are open, kept in a bitset keyed by free space, so the
best fit for a piece is the lowest set bit at or above its length; when one more has to open, the fullest closes.
Every task packs its own stream of pieces as they come, in the order of a hash, which doesn't know their lengths; so
the bound binds in every stream of some hundred pieces. A stream has at least STREAM pieces while there are as
many, so the sequences left part empty at the streams' ends stay a small part at every size.

Cases: null text is empty and, like empty text, gives the end token alone; repeated rows and null doc_ids are packed
one by one; a very long text is cut into full pieces; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, written

LENGTH = 1024
#: Of random order and documents of 460 tokens on average, sequences are 1 % more than full ones; from 128 bins on the bound costs nothing.
OPEN_BINS = 256
STREAM = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def encoder(path: str):
    """texts -> lists of ids, as the `tokenizers` file at `path` gives them with add_special_tokens=False.

    Where the same vocabulary lies beside it as ranks, a faster library with the same ids encodes; texts holding
    a special token's string go to the file's own library.
    """
    import base64
    import json
    import os

    special = [t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])]
    slow = lambda t: _own(path).encode(t, add_special_tokens=False).ids
    ranks = path.removesuffix(".json") + ".tiktoken"
    try:
        import public_tokenizers
        import tiktoken

        if not os.path.exists(ranks):
            return lambda texts: [slow(t) for t in texts]
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    except ImportError:
        return lambda texts: [slow(t) for t in texts]
    return lambda texts: [slow(t) if any(s in t for s in special) else fast(t) for t in texts]


@lru_cache(4)
def _own(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces behind a first one with the rest."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(s, length) for s in range(first, n, length)]


def token_pieces(docs: DataFrame, path: str, end: int = 2, length: int = LENGTH) -> DataFrame:
    """The pieces of docs(doc_id, text), with the checksum of each one's ids."""

    def encode(batches):
        import pyarrow as pa

        encode = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[list] = [[], [], [], [], []]
            for at in range(0, len(ids), 256):
                some = [t or "" for t in texts.slice(at, 256).to_pylist()]
                for doc, tokens in zip(ids[at : at + 256], encode(some)):
                    tokens.append(end)
                    raw = memoryview(np.array(tokens, "<u4")).cast("B")
                    for k, (s, n) in enumerate(cut(len(tokens), length)):
                        for column, x in zip(out, (doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)]))):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(encode), PIECES)


class Bins:
    """Open bins by free space; the bit f of `bits` says that some open bin has f free."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.most, self.bits, self.open, self.made, self.closed = length, open_bins, 0, 0, 0, 0
        self.by: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, n: int) -> tuple[int, int]:
        """The bin and the place in it for a piece of n."""
        fitting = self.bits >> n
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + n
            i = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            i, free = self.made, self.length
            self.made += 1
        if free > n:
            self.by[free - n].append(i)
            self.bits |= 1 << (free - n)
            self.open += 1
        return i, self.length - free

    def _take(self, free: int) -> int:
        i = self.by[free].pop()
        self.open -= 1
        if not self.by[free]:
            self.bits &= ~(1 << free)
        return i


def packed(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, stream: int = STREAM) -> DataFrame:
    """pieces with sequence_id and offset; a piece needs a `length` from 1 to the sequences' length."""
    pieces = written(pieces, "pieces")
    streams = max(1, pieces.where(F.col("length") < length).count() // stream)
    columns = pieces.columns

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        bins, base = Bins(length, open_bins), TaskContext.get().partitionId() << 33
        for batch in batches:
            got = [bins.put(n) for n in batch.column(columns.index("length")).to_pylist()]
            ids = pa.array([base + i for i, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], ids, pa.array([o for _, o in got], pa.int64())], [*columns, "sequence_id", "offset"])

    order = F.xxhash64(*columns)
    dealt = pieces.repartition(streams, order).sortWithinPartitions(order, *columns)
    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return dealt.mapInArrow(lean(pack), kinds + ", sequence_id long, `offset` long")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(token_pieces(docs, public_path()))
