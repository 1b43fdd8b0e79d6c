"""Operator 7: toxicity by a convolutional text classifier.

A token is a run of letters, digits and bytes beyond ASCII, A-Z as a-z. Its embedding is the sum of three rows of a
hashed table: of the token, and of its first 4 and 5 bytes. Filters over 1, 2 and 3 tokens are max-pooled over the
whole text, and a logistic layer gives the score. The table's first coordinate starts from each row's log odds; all of it is
then trained in numpy with sparse Adagrad (only rows that win a pool change). For scoring, table and filters are
multiplied out once, so a token costs three row look-ups.

Every labelled document that isn't held out counts. The query trains on all of them. With thresholds by language, as in the pipeline,
four fifths are trained on, by hash, and on all of the others each language's threshold is calibrated: the best F1 over its own rows and PRIOR rows' worth of all languages', so a language with few labels stays
close to all. The intercept is moved to the shares of all labels. The score itself never sees the language.

Up to SHARD_BYTES of labelled text and SHARD_ROWS documents are fitted by one task. Beyond, documents lie in shards of about that size by
hash: log odds are counted over all of them, then in each of ROUNDS rounds every shard trains from the same
model, STEPS / ROUNDS batches or once over its documents, whichever is more; the next round starts from the means
(of a row of the table: over the shards that changed it). Documents, not layout, say which shard they are in.

Cases: null and empty texts get the score of a text without tokens; null doc_ids aren't held out; without labels
of both kinds every score is the share of toxic labels (0 without labels); of repeated labels the highest counts, and of repeated
documents one is fitted on; repeated rows get equal scores; very long texts are read whole; an empty
table gives an empty table; other columns stay (`scored` replaces those with the names it adds).
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits_for, bloom, forget, in_bloom, lean, mix64, pieces, text_bytes, written

ROW_BITS = 17
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bytes of text and documents that one task trains on, and rounds of training where there are more.
SHARD_BYTES, SHARD_ROWS, ROUNDS = 32_000_000, 20_000, 2
#: Batches of training, rows of one, and tokens that are looked at together.
STEPS, BATCH, WINDOW = 800, 48, 1 << 18
#: Rows of the table that are averaged together.
PART = 256
THRESHOLD = 0.3
#: Thresholds to choose from, the first of equals, and the rows of all languages that count for each one.
CUTS, PRIOR = (0.3, 0.2, 0.4, 0.5, 0.15, 0.6, 0.1, 0.7, 0.8, 0.9), 10
BLOCK = 250_000
PAD = 2

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_tables: dict = {}


def _powers(n: int):
    t = _tables
    if len(t.get("up", ())) < n:
        codes = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
        codes[65:91] = codes[97:123]
        word = np.zeros(256, bool)
        for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
            word[a:b] = True
        t.update(codes=codes, word=word)
        for name, base in (("up", _BASE), ("down", _U(pow(int(_BASE), -1, 1 << 64)))):
            x = np.full(n, base, _U)
            x[0] = 1
            t[name] = np.multiply.accumulate(x)
    return t["codes"], t["word"], t["up"], t["down"]


def token_rows(raw: np.ndarray, offsets: np.ndarray, bits: int = ROW_BITS):
    """Yields (first row, row after the last, ids, ends): ids (tokens, 3) of table rows with PAD empty tokens after each text, ends of the texts in ids."""
    for first, last in pieces(offsets, BLOCK):
        base = offsets[first]
        text, at = raw[base : offsets[last]], offsets[first : last + 1] - base
        size, rows = len(text), last - first
        codes, word, up, down = _powers(size + 1)
        now = np.zeros(size + 1, bool)
        now[:size] = word[text]
        before = np.zeros(size + 1, bool)
        before[1:] = now[:size]
        edge = np.zeros(size + 1, bool)
        edge[at] = True
        starts = np.flatnonzero(now & (~before | edge))
        ends = np.flatnonzero(before & (~now | edge))
        total = np.zeros(size + 1, _U)
        np.cumsum(codes[text] * up[:size], out=total[1:])
        count = np.diff(np.searchsorted(starts, at))
        stop = np.cumsum(count + PAD)
        ids = np.full((len(starts) + PAD * rows, 3), 1 << bits, np.int32)
        put = np.arange(len(starts)) + np.repeat(np.arange(rows) * PAD, count)
        for k, to in enumerate((ends, np.minimum(ends, starts + 4), np.minimum(ends, starts + 5))):
            got = mix64((total[to] - total[starts]) * down[starts] + _U(k + 1) * _BASE)
            ids[put, k] = (got >> _U(64 - bits)).astype(np.int32)
        yield first, last, ids, stop


def _conv(parts: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """Pre-activations of all filters at all places, -inf where a filter would leave its text."""
    n, out, at = len(parts), [], 0
    for w in WIDTHS:
        y = parts[:, at : at + FILTERS].copy()
        for j in range(1, w):
            y[: n - j] += parts[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
        for j in range(1, w):
            y[stops - j] = -np.inf
        out.append(y)
        at += w * FILTERS
    return np.concatenate(out, axis=1)


#: A model's trained arrays beside the table.
DENSE = ("filters", "bias", "weights")


def seen_in(texts: list[np.ndarray], positive: np.ndarray, bits: int = ROW_BITS) -> np.ndarray:
    """How many clean and how many toxic texts have each row of the table."""
    seen = np.zeros((2, (1 << bits) + 1))
    for ids, y in zip(texts, positive):
        seen[int(y), np.unique(ids)] += 1
    return seen


class Model:
    """table (rows + 1, DIM), whose last row is empty; filters (DIM, sum of widths x FILTERS); bias, weights, intercept."""

    def __init__(self, bits: int = ROW_BITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits, n = bits, len(WIDTHS) * FILTERS
        self.table = rng.normal(0, 0.05, ((1 << bits) + 1, DIM)).astype(np.float32)
        self.table[-1] = 0
        self.filters = rng.normal(0, 0.3, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32)
        self.bias = np.full(n, 0.1, np.float32)
        self.weights = rng.normal(0, 0.1, n).astype(np.float32)
        self.intercept = 0.0
        self.constant: float | None = None
        self.thresholds: dict = {}

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> None:
        """texts: arrays (tokens + PAD, 3) of table rows."""
        positive = labels > 0
        self.begin(seen_in(texts, positive, self.bits), int((~positive).sum()), int(positive.sum()))
        self.learn(texts, positive, steps)
        self.finish()

    def begin(self, seen: np.ndarray, clean: int, toxic: int) -> None:
        """Start from log odds. seen: how many clean and how many toxic texts have each row."""
        odds = np.log((seen[1] + 1) / (max(1, toxic) + 2)) - np.log((seen[0] + 1) / (max(1, clean) + 2))
        odds *= np.minimum(1, seen.sum(0) / 8)
        self.table[:, 0] = np.clip(odds, -3, 3) * 0.3
        self.table[-1] = 0
        self.filters[0, :FILTERS] = np.abs(self.filters[0, :FILTERS]) + 0.5
        self.weights[:FILTERS] = np.abs(self.weights[:FILTERS]) + 0.2
        self.intercept = -1.0
        self.touched = np.zeros((1 << self.bits) + 1, bool)
        self.square = {k: np.full_like(getattr(self, k), 1e-2) for k in ("table", *DENSE)}
        self.square["intercept"] = 1e-2

    def learn(self, texts: list[np.ndarray], positive: np.ndarray, steps: int, rate: float = 0.1, seed=7) -> None:
        rng = np.random.default_rng(seed)
        size, square = 1 << self.bits, self.square

        def step(name, at, grad):
            sq, x = square[name], getattr(self, name)
            sq[at] += grad * grad
            x[at] -= rate * grad / np.sqrt(sq[at])

        waiting: list = []
        for _ in range(steps):
            while len(waiting) < min(BATCH, len(texts)):
                waiting += rng.permutation(len(texts)).tolist()
            batch, waiting = waiting[:BATCH], waiting[BATCH:]
            ids = np.concatenate([texts[i] for i in batch])
            stops = np.cumsum([len(texts[i]) for i in batch])
            top, where = self.pooled(ids, np.concatenate(([0], stops[:-1])), stops)
            hidden = np.maximum(top + self.bias, 0)
            hidden[~np.isfinite(top)] = 0
            logit = hidden @ self.weights + self.intercept
            g = (1 / (1 + np.exp(-logit)) - positive[batch]) / len(batch)
            d_weights = hidden.T @ g + 1e-4 * self.weights
            d_hidden = np.where(hidden > 0, g[:, None] * self.weights, 0).astype(np.float32)
            d_filters, rows, grads, at = np.zeros_like(self.filters), [], [], 0
            for i, w in enumerate(WIDTHS):
                mine = slice(i * FILTERS, (i + 1) * FILTERS)
                b, f = np.nonzero(d_hidden[:, mine])
                d, place = d_hidden[:, mine][b, f], where[:, mine][b, f]
                for j in range(w):
                    columns = at + j * FILTERS + f
                    np.add.at(d_filters.T, columns, d[:, None] * self.table[ids[place + j]].sum(1))
                    rows.append(ids[place + j])
                    grads.append(d[:, None] * self.filters.T[columns])
                at += w * FILTERS
            if rows:
                rows_, grads_ = np.concatenate(rows).ravel(), np.repeat(np.concatenate(grads), 3, axis=0)
                unique, back = np.unique(rows_, return_inverse=True)
                total = np.zeros((len(unique), DIM), np.float32)
                np.add.at(total, back, grads_)
                keep = unique < size
                self.touched[unique[keep]] = True
                step("table", unique[keep], total[keep] + 1e-5 * self.table[unique[keep]])
            step("filters", slice(None), d_filters + 1e-5 * self.filters)
            step("bias", slice(None), d_hidden.sum(0))
            step("weights", slice(None), d_weights)
            square["intercept"] += float(g.sum()) ** 2
            self.intercept -= rate * float(g.sum()) / square["intercept"] ** 0.5

    def pooled(self, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        """Each text's greatest pre-activations and their places; a long text is looked at in windows."""
        n = len(WIDTHS) * FILTERS
        top, where = np.full((len(stops), n), -np.inf, np.float32), np.repeat(starts[:, None], n, axis=1)

        def look(rows, a, b):
            at = a[0]
            y = _conv(self.table[ids[at : b[-1]]].sum(1) @ self.filters, a - at, b - at)
            place = np.stack([i + y[i:j].argmax(0) for i, j in zip((a - at).tolist(), (b - at).tolist())])
            best = np.take_along_axis(y, place, 0)
            better = best > top[rows]
            top[rows], where[rows] = np.where(better, best, top[rows]), np.where(better, place + at, where[rows])

        first = 0
        while first < len(stops):
            last = max(first + 1, int(np.searchsorted(stops, starts[first] + WINDOW, side="right")))
            if stops[first] - starts[first] <= WINDOW:
                look(slice(first, last), starts[first:last], stops[first:last])
            else:
                for a in range(starts[first], max(starts[first] + 1, stops[first] - PAD), WINDOW):
                    look(slice(first, last), np.array([a]), np.array([min(a + WINDOW + PAD, stops[first])]))
            first = last
        return top, where

    def state(self):
        """What learn() changed: yields (part, rows, values); part -1 is all but the table."""
        dense = [getattr(self, k) for k in DENSE] + [self.square[k] for k in DENSE] + [[self.intercept, self.square["intercept"]]]
        yield -1, np.zeros(1, np.int32), np.concatenate([np.ravel(x) for x in dense]).astype(np.float32)[None]
        rows = np.flatnonzero(self.touched).astype(np.int32)
        for some in np.split(rows, np.flatnonzero(np.diff(rows // PART)) + 1):
            if len(some):
                yield int(some[0]) // PART, some % PART, np.concatenate([self.table[some], self.square["table"][some]], axis=1)

    def take(self, part: int, rows: np.ndarray, values: np.ndarray) -> None:
        """The reverse of state()."""
        if part >= 0:
            rows = rows + part * PART
            self.table[rows], self.square["table"][rows], self.touched[rows] = values[:, :DIM], values[:, DIM:], True
            return
        values, at = values[0], 0
        for to in (self.__dict__, self.square):
            for k in DENSE:
                n = to[k].size
                to[k], at = values[at : at + n].reshape(to[k].shape).copy(), at + n
        self.intercept, self.square["intercept"] = map(float, values[at:])

    def finish(self) -> None:
        self.table[~self.touched, 1:] = 0
        del self.touched, self.square

    def ready(self) -> np.ndarray:
        return self.table @ self.filters

    def scores(self, ready: np.ndarray, ids: np.ndarray, stops: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stops), self.constant)
        starts = np.concatenate(([0], stops[:-1]))
        parts = ready[ids[:, 0]] + ready[ids[:, 1]] + ready[ids[:, 2]]
        top = np.maximum.reduceat(_conv(parts, starts, stops), starts, axis=0)
        hidden = np.where(np.isfinite(top), np.maximum(top + self.bias, 0), 0)
        return 1 / (1 + np.exp(-(hidden @ self.weights + self.intercept).astype(np.float64)))


def _counts(score: np.ndarray, y: np.ndarray, cut: float) -> tuple:
    """How many are found and toxic, found, and toxic."""
    hit = score >= cut
    return (hit & (y > 0)).sum(), hit.sum(), (y > 0).sum()


def _best(counts: np.ndarray, pooled: np.ndarray) -> float:
    """The threshold with the best F1; counts: what _counts gives for each of CUTS, pooled: the same of all languages, a row."""
    f1 = [2 * both / (hits + toxic) if hits + toxic else 0.0 for both, hits, toxic in counts + PRIOR * pooled]
    return CUTS[int(np.argmax(np.round(f1, 9)))]


def fitted(rows: list[tuple], shares: tuple[int, int], bits: int = ROW_BITS, calibrated: bool = True) -> Model:
    """A model from all rows (text ids, toxic, lang) in one task; shares: the numbers of clean and of toxic labels among all."""
    model, clean, toxic = Model(bits), *shares
    y = np.array([r[1] for r in rows], np.int64)
    if not len(rows) or y.min() == y.max():
        model.constant = toxic / max(1, clean + toxic)
        return model
    held = np.arange(len(rows)) % 5 == (4 if calibrated else -1)
    train = np.flatnonzero(~held)
    if y[train].min() == y[train].max():
        train = np.arange(len(rows))
    model.fit([rows[i][0] for i in train], y[train])
    model.intercept += np.log(max(toxic, 1) / max(clean, 1)) - np.log(max(1, y[train].sum()) / max(1, (1 - y[train]).sum()))
    if not calibrated:
        return model
    ready = model.ready()
    score = np.array([model.scores(ready, r[0], np.array([len(r[0])]))[0] for r in rows])
    langs = np.array([r[2] or "" for r in rows])
    pooled = np.array([_counts(score[held], y[held], cut) for cut in CUTS]) / max(1, held.sum())
    for lang in {r[2] for r in rows}:
        mine = held & (langs == (lang or ""))
        model.thresholds[lang] = _best(np.array([_counts(score[mine], y[mine], cut) for cut in CUTS]), pooled)
    return model


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int | None = None, negatives: int | None = None, calibrated: bool = True) -> Model:
    """A model from docs(doc_id, text, lang) and labels(doc_id, toxic) without the held-out ids; calibrated: with thresholds by language.

    All labelled documents count, unless the caller asks for only so many toxic and clean ones, the first by hash.
    """
    labels = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    labels = written(labels, "labels")
    count = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    shares = count.get(0, 0), count.get(1, 0)
    for y, most in ((0, negatives), (1, positives)):
        if most is not None:
            labels = labels.where(F.col("toxic") != y).unionByName(labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    size = docs.select("doc_id", F.octet_length("text").alias("n")).join(labels, "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-size.bytes // SHARD_BYTES), -(-size.rows // SHARD_ROWS))
    rows = _labelled(docs, labels, sum(shares), shards, calibrated)
    if shards > 1:
        rows = written(rows, "shards")
        model = _fitted_by_shards(rows, shares, calibrated)
        forget(rows)
        return model

    def run(batches):
        import pyarrow as pa

        mine = [(ids, y, lang) for _, ids, y, lang in _texts(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(mine, shares, calibrated=calibrated))], pa.binary())], ["model"])

    got = rows.mapInArrow(lean(run), "model binary").collect()
    return pickle.loads(got[0].model) if got else fitted([], shares)


def _labelled(docs: DataFrame, labels: DataFrame, n: int, shards: int, calibrated: bool) -> DataFrame:
    """Rows (text, lang, toxic, shard, rest), one a labelled document, a partition a shard; rest: it calibrates thresholds and isn't trained on.

    A filter keeps most documents without a label out of the shuffle. Of documents with equal ids the shortest stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bloom(labels.select(F.col("doc_id").alias("key")), bits_for(16 * n, 10, 28)))

    def known(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            hit = in_bloom(shared.value, ids.fill_null(0).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(hit & ids.is_valid().to_numpy(zero_copy_only=False)))

    def firsts(batches):
        import pyarrow as pa

        last = np.zeros(1, np.int64), np.full(1, -1)  # the row before: its doc_id and, where it is a label, what it says
        for batch in batches:
            if len(batch):
                ids, toxic = (np.concatenate((x, batch.column(k).to_numpy(zero_copy_only=False))) for k, x in enumerate(last))
                new = (toxic[1:] < 0) & (toxic[:-1] >= 0) & (ids[1:] == ids[:-1])
                last = ids[-1:].copy(), toxic[-1:].copy()
                kept = batch.filter(pa.array(new))
                yield pa.RecordBatch.from_arrays([*kept.columns[2:4], pa.array(toxic[:-1][new], pa.int32()), *kept.columns[4:]], ["text", "lang", "toxic", "shard", "rest"])

    # a label comes just before the documents with its id; a join would choose its own partitions, and shuffle the texts again
    rows = docs.mapInArrow(lean(known), docs.schema).select("doc_id", F.lit(-1).alias("toxic"), "text", "lang")
    rows = rows.unionByName(labels.select("doc_id", "toxic"), allowMissingColumns=True).repartition(shards, "doc_id")
    rows = rows.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.col("toxic") < 0, F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64("text", "lang"))
    shard = F.pmod(F.hash("doc_id"), F.lit(shards)).alias("shard")
    rows = rows.select("doc_id", "toxic", "text", "lang", shard, (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == (4 if calibrated else -1)).alias("rest"))
    return rows.mapInArrow(lean(firsts), "text string, lang string, toxic int, shard int, rest boolean")


def _texts(batches):
    """Yields (shard, ids, toxic, lang) of each row (text, lang, toxic, shard, ...)."""
    with np.errstate(over="ignore"):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            langs, toxic, shard = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for a, _, ids, stops in token_rows(raw, offsets):
                for i, part in enumerate(np.split(ids, stops[:-1]), a):
                    yield shard[i], part.copy(), toxic[i], langs[i]


def _fitted_by_shards(rows: DataFrame, shares: tuple[int, int], calibrated: bool) -> Model:
    """A model from all rows of _labelled(), as fitted() gives, by one task a shard."""
    kinds = {(r.rest, r.toxic) for r in rows.select("rest", "toxic").distinct().collect()}
    both = {(False, 0), (False, 1)} <= kinds
    model = _learned(rows.where("not rest") if both else rows, shares)
    if calibrated and model.constant is None:
        judged = _scores_of(rows.where("rest"), model)
        counts = []  # as _counts gives them
        for cut in CUTS:
            hit = F.col("score") >= cut
            counts += [F.count_if(hit & (F.col("toxic") > 0)), F.count_if(hit), F.count_if(F.col("toxic") > 0)]
        by = {r[0]: (r[1], np.array(r[2:]).reshape(-1, 3)) for r in judged.groupBy("lang").agg(F.count(F.lit(1)), *counts).collect()}
        none = 0, np.zeros((len(CUTS), 3))
        pooled = sum((x for _, x in by.values()), none[1]) / max(1, sum(n for n, _ in by.values()))
        model.thresholds = {r.lang: _best(by.get(r.lang, none)[1], pooled) for r in rows.select("lang").distinct().collect()}
    return model


def _scores_of(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (lang, toxic, score) of rows of _labelled()."""
    shared, columns = rows.sparkSession.sparkContext.broadcast(model), rows.columns

    def judge(batches):
        import pyarrow as pa

        for batch, score, _ in _judged(batches, shared.value, columns):
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(score, pa.float64())], ["lang", "toxic", "score"])

    return rows.mapInArrow(lean(judge), "lang string, toxic int, score double")


def _learned(rows: DataFrame, shares: tuple[int, int]) -> Model:
    """A model without thresholds, trained on rows of _labelled()."""
    model, clean, toxic = Model(), *shares
    count = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(count) < 2:
        model.constant = toxic / max(1, clean + toxic)
        return model
    seen = np.zeros((2, (1 << model.bits) + 1))
    got = rows.mapInArrow(lean(_seen), "row int, clean long, toxic long").groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen[:, got["row"].to_numpy()] = got["clean"].to_numpy(), got["toxic"].to_numpy()
    model.begin(seen, count[0], count[1])
    for k in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(model)
        parts = rows.mapInArrow(lean(_learning(shared, k, STEPS // ROUNDS)), "part int, shard int, at binary, value binary")
        means = parts.repartition("part").sortWithinPartitions("part", "shard", F.xxhash64("at", "value")).mapInArrow(lean(_means), "part int, at binary, value binary")
        for r in means.collect():
            model.take(r.part, *_unpacked(r.at, r.value))
        shared.destroy()
    model.finish()
    model.intercept += np.log(max(toxic, 1) / max(clean, 1)) - np.log(count[1] / count[0])
    return model


def _seen(batches):
    """How many clean and toxic texts have each row of the table, over one partition."""
    import pyarrow as pa

    seen = np.zeros((2, (1 << ROW_BITS) + 1), np.int64)
    for _, ids, y, _ in _texts(batches):
        seen[int(y > 0), np.unique(ids)] += 1
    some = np.flatnonzero(seen.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[0, some]), pa.array(seen[1, some])], ["row", "clean", "toxic"])


def _learning(shared, k: int, steps: int):
    """A function of mapInArrow: each shard's state after round k of training."""

    def run(batches):
        import copy

        import pyarrow as pa

        def learned(shard, texts, positive):
            model = copy.deepcopy(shared.value)
            model.touched[:] = False
            model.learn(texts, np.array(positive), max(steps, -(-len(texts) // BATCH)), seed=(7, k, shard))
            got = [(part, at.astype(np.int32).tobytes(), value.tobytes()) for part, at, value in model.state()]
            part, at, value = zip(*got)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([shard] * len(got), pa.int32()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["part", "shard", "at", "value"])

        now, texts, positive = None, [], []
        for shard, ids, y, _ in _texts(batches):
            if shard != now and texts:
                yield learned(now, texts, positive)
                texts, positive = [], []
            now = shard
            texts.append(ids)
            positive.append(y > 0)
        if texts:
            yield learned(now, texts, positive)

    return run


def _unpacked(at: bytes, value: bytes):
    rows = np.frombuffer(at, np.int32)
    return rows, np.frombuffer(value, np.float32).reshape(len(rows), -1)


def _means(batches):
    """The mean of each row of the table over the shards that changed it, and of all else over all shards, in the order of the shards."""
    import pyarrow as pa

    def mean(part, total, n):
        at = np.flatnonzero(n)
        value = (total[at] / n[at, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at.astype(np.int32).tobytes()]), pa.array([value.tobytes()])], ["part", "at", "value"])

    now, total, n = None, None, None
    for batch in batches:
        for part, at, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            rows, values = _unpacked(at, value)
            if part != now:
                if now is not None:
                    yield mean(now, total, n)
                now, total, n = part, np.zeros((PART, values.shape[1])), np.zeros(PART)
            total[rows] += values
            n[rows] += 1
    if now is not None:
        yield mean(now, total, n)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _score and _threshold (its language's), from the columns text and lang; all columns stay."""
    docs = docs.drop("_score", "_threshold")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch, score, cut in _judged(batches, shared.value, columns):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array(cut, pa.float64())], [*columns, "_score", "_threshold"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(lean(run), kinds + ", _score double, _threshold double")


def cleaned(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose score reaches their language's threshold; the columns stay the same."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch, score, cut in _judged(batches, shared.value, columns):
            yield batch.take(pa.array(np.flatnonzero(score < cut)))

    return docs.mapInArrow(lean(run), docs.schema)


def _judged(batches, model: Model, columns: list[str]):
    """Each batch with its rows' scores and thresholds."""
    ready = None
    with np.errstate(over="ignore"):
        for batch in batches:
            if ready is None:
                ready = model.ready()
            raw, offsets = text_bytes(batch.column(columns.index("text")))
            score = [model.scores(ready, ids, stops) for _, _, ids, stops in token_rows(raw, offsets, model.bits)]
            cut = [model.thresholds.get(x, THRESHOLD) for x in batch.column(columns.index("lang")).to_pylist()]
            yield batch, np.concatenate(score) if score else np.zeros(0), np.array(cut, np.float64)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), calibrated=False)
    rows = scored(docs, model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
