"""Operator 8: personal data, by fixed patterns and a skip-chain conditional random field.

The patterns find the base spans. The field then labels what they leave: its tokens are the runs of a text that look
like numbers or addresses (also spelled ones, `name at host dot org`), in a chain. Skip edges join each token to the one before it with the same
key (the same last seven digits, four equal groups or the same address), however far away, and to the one before it that is similar (a
number with one digit changed or in the same shape, an address in the same domain). Base spans are observed tokens. Loopy
sum-product messages run over all edges, damped ever more, until they settle, so a number written once with its country
code and once without gets one label. Weights of the nodes' features and the potentials of the three kinds of edges are trained together in
numpy, by gradients from the same messages, on generated texts with all five labels (a seed fixes them), once on the driver.

Every pattern is applied so that it takes time in proportion to the text. Numbers of fewer than four digits are no tokens, as
no kind has so few. Cases: null and empty texts have no spans; very long texts are one graph;
repeated rows and null doc_ids are rows like any other; an empty table gives an empty table; other columns are
ignored by the query and kept by `masked`.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Marginal probability from which the field adds a span.
SURE = 0.7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PARTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"\(?[0-9][0-9\s().-]*", re.ASCII)
_CHUNK = re.compile(r"[^\s]+")
_RUN = re.compile(r"[0-9]+")
_AT = re.compile(r"\s?[\[(]at[\])]\s?|\sat\s|\s@\s")
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?:(?:\s?[\[(]dot[\])]\s?|\sdot\s|\.)[A-Za-z0-9-]+)+")
_DOT = re.compile(r"\s?[\[(]dot[\])]\s?|\sdot\s")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start, then kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    for m in _PARTS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts, start = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((start, end, "ip"))
            start = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def _keys(text: str) -> tuple[str, list[str]]:
    """What equal tokens share, and what similar ones share."""
    if not (text[:1].isdigit() or text[:1] in "+("):
        name = _DOT.sub(".", _AT.sub("@", text)).lower()
        return name, ["@" + name.partition("@")[2]]
    groups = _RUN.findall(text)
    digits = "".join(groups)
    shape = "s" + _RUN.sub(lambda m: str(len(m.group())), text)
    if len(groups) == 4 and max(map(len, groups)) <= 3:
        return ".".join(groups), [shape, "i" + ".".join(groups[:3])]
    if len(digits) < 7:
        return "", []
    return "#" + digits[-7:], [shape, "h" + digits[-7:-4], "t" + digits[-4:]]


def _similar(a: str, b: str, share: str) -> bool:
    """Whether tokens that share a part are similar: halves of numbers count where only one of the last seven digits differs."""
    if share[0] not in "ht":
        return True
    return sum(x != y for x, y in zip(_digits(a)[-7:], _digits(b)[-7:])) == 1


def _cue(text: str, start: int) -> str:
    """The word before a place, if only blanks and signs lie between."""
    end = start
    while end and not text[end - 1].isalnum():
        end -= 1
    at = end
    while at and text[at - 1].isalpha():
        at -= 1
    return text[at:end].lower()


def _features(text: str, start: int, end: int) -> list[str]:
    token = text[start:end]
    digits = _digits(token)
    before, after = text[start - 1 : start], text[end : end + 1]
    out = ["bias", f"c{_cue(text, start)}", f"b{before if not before.isspace() else ''}", f"a{after if after in ':/=%' else ''}"]
    if not (token[0].isdigit() or token[0] == "("):
        spelled = "at" if "@" not in token else "@"
        return [*out, spelled, f"dots{min(len(re.findall(_DOT, token)) + token.count('.'), 3)}", f"w{'[' in token or '(' in token}"]
    groups = _RUN.findall(token)
    out += [f"n{min(len(digits), 20)}", f"s{_RUN.sub(lambda m: str(len(m.group())), token)}", f"g{min(len(groups), 6)}"]
    if 12 <= len(digits) <= 19:
        out += ["card", f"luhn{luhn(digits)}"]
    if len(groups) == 4 and max(map(len, groups)) <= 3:
        out.append(f"bytes{all(int(g) <= 255 for g in groups)}")
    return out


def _at_words(text: str):
    """(start, end) of each run without blanks around an @ (up to the next @ on either side), and of each spelled address."""
    at, last = text.find("@"), -1
    while at >= 0:
        start, end = at, at + 1
        while start > last + 1 and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end] != "@" and not text[end].isspace():
            end += 1
        if start < at and end > at + 1:
            yield start, end
        last, at = at, text.find("@", at + 1)
    last = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (to := _SPELLED.match(text, m.end())):
            yield start, to.end()
        last = m.end()


def _numbers(text: str):
    """(start, end) of runs like numbers. Blanks and line ends join their parts up to 19 digits, but not to a part that is a number by itself."""
    for m in _NUMBER.finditer(text):
        start = end = None
        have = 0
        for c in _CHUNK.finditer(m.group()):
            n = sum(x.isdigit() for x in c.group())
            if start is not None and (have + n > 19 or n >= 9 or have >= 9 and n < 4):
                yield start, end
                start, have = None, 0
            if start is None:
                start = m.start() + c.start()
            end, have = m.start() + c.end(), have + n
            if n >= 9:
                yield start, end
                start, have = None, 0
        if start is not None:
            yield start, end


def _tokens(text: str, base: list[tuple[int, int, str]]):
    """(start, end, observed label or None) of base spans and of the runs that touch none, in order."""
    out = [(s, e, LABELS.index(k)) for s, e, k in base]
    spans, i = sorted((s, e) for s, e, _ in base), 0
    reach = 0
    for s, e in sorted({*_numbers(text), *_at_words(text)}):
        while e > s and not text[e - 1].isalnum():
            e -= 1
        while i < len(spans) and spans[i][0] < e:
            reach = max(reach, spans[i][1])
            i += 1
        if reach > s or e <= s or text[s - 1 : s].isalnum() or text[e : e + 1].isalnum():
            continue
        if (text[s].isdigit() or text[s] == "(") and sum(c.isdigit() for c in text[s:e]) < 4:
            continue
        out.append((s, e, None))
        reach = e
    out.sort(key=lambda x: x[:2])
    return out


def _edges(text: str, tokens) -> list[tuple[int, int, int]]:
    """(token, later token, kind): 0 in the chain, 1 equal, 2 similar."""
    out = [(i - 1, i, 0) for i in range(1, len(tokens))]
    equal: dict[str, int] = {}
    similar: dict[str, int] = {}
    for i, (s, e, _) in enumerate(tokens):
        key, shares = _keys(text[s:e])
        if not key:
            continue
        if key in equal:
            out.append((equal[key], i, 1))
        equal[key] = i
        for share in shares:
            if share in similar:
                j = similar[share]
                a, b = text[tokens[j][0] : tokens[j][1]], text[s:e]
                if _keys(a)[0] != key and _similar(a, b, share):
                    out.append((j, i, 2))
            similar[share] = i
    return out


class Messages:
    """Sum-product messages over the edges (a, b, kind) of a graph."""

    def __init__(self, edges):
        edges = sorted(edges, key=lambda e: e[2])
        self.a, self.b, self.kind = (np.array([e[i] for e in edges], np.int64) for i in range(3))
        self.right, self.left = np.zeros((len(edges), len(LABELS))), np.zeros((len(edges), len(LABELS)))
        at = np.searchsorted(self.kind, [0, 1, 2, 3])
        self.runs = [slice(s, e) for s, e in zip(at, at[1:])]

    def beliefs(self, local: np.ndarray) -> np.ndarray:
        out = local.copy()
        np.add.at(out, self.b, self.right)
        np.add.at(out, self.a, self.left)
        return out

    def step(self, local: np.ndarray, table: np.ndarray, share: float) -> float:
        """All messages once, moved by `share` of the way; the greatest change. table: exponentials of the potentials by kind."""
        belief, new = self.beliefs(local), []
        for frm, back, t in ((self.a, self.left, table), (self.b, self.right, table.transpose(0, 2, 1))):
            x = belief[frm] - back
            x = np.exp(x - x.max(1, keepdims=True))
            y = np.log(np.concatenate([x[run] @ one for run, one in zip(self.runs, t)]) + 1e-300)
            new.append(y - y.max(1, keepdims=True))
        moved = max(np.abs(new[0] - self.right).max(), np.abs(new[1] - self.left).max()) * share
        self.right += share * (new[0] - self.right)
        self.left += share * (new[1] - self.left)
        return moved

    def settle(self, local: np.ndarray, table: np.ndarray) -> None:
        """Until no message moves: steps are whole at first, then shrink, so this ends on every graph."""
        share = 1.0
        while self.step(local, table, share) > 1e-4:
            share *= 0.98

    def pairs(self, local: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The marginals of the edges' ends."""
        belief = self.beliefs(local)
        x, y = belief[self.a] - self.left, belief[self.b] - self.right
        p = np.exp(x - x.max(1, keepdims=True))[:, :, None] * table[self.kind] * np.exp(y - y.max(1, keepdims=True))[:, None, :]
        return p / p.sum((1, 2), keepdims=True)


def _soft(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


#: The log potential of labels that an observed token doesn't have.
_OFF = -30.0


class Field:
    """node: weights by feature; edge: log potentials between labels, by kind of edge."""

    def __init__(self, node: dict[str, np.ndarray], edge: np.ndarray):
        self.node, self.edge = node, edge

    def marginals(self, text: str, tokens) -> np.ndarray:
        local = np.zeros((len(tokens), len(LABELS)))
        for i, (s, e, seen) in enumerate(tokens):
            if seen is None:
                for f in _features(text, s, e):
                    if (w := self.node.get(f)) is not None:
                        local[i] += w
            else:
                local[i] = _OFF
                local[i, seen] = 0
        edges = _edges(text, tokens)
        if not edges:
            return _soft(local)
        messages = Messages(edges)
        messages.settle(local, np.exp(self.edge))
        return _soft(messages.beliefs(local))


_FILL = "the of and to in it was for on with as at be this from or had by but some we when they after".split()


def _forms(rng, kind: int):
    """(plain forms, hidden ones) of one made entity: the patterns find the plain ones, and not the hidden ones."""
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda x: x[int(rng.integers(len(x)))]
    if kind == 1:
        name, host, end = f"{pick(_FILL)}{pick(['.', '_', ''])}{digits(2)}", f"{pick(['mail', 'web', 'post', 'my'])}{pick(_FILL)}", pick(["com", "org", "net", "io"])
        return [f"{name}@{host}.{end}"], [f"{name} at {host} dot {end}", f"{name}[at]{host}[dot]{end}", f"{name} (at) {host} (dot) {end}", f"{name} [at] {host}.{end}", f"{name} @ {host}.{end}", f"{name}@{host}"]
    if kind == 2:
        parts = [str(int(x)) for x in rng.integers(1, 255, 4)]
        return [".".join(parts)], ["-".join(parts), " ".join(parts), ". ".join(parts), f"{'.'.join(parts[:2])}.\n{'.'.join(parts[2:])}"]
    if kind == 3:
        d = f"4{digits(14)}"
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        four = [d[i : i + 4] for i in range(0, 16, 4)]
        return [d, " ".join(four), "-".join(four)], [".".join(four), "  ".join(four), f"{' '.join(four[:2])}\n{' '.join(four[2:])}", " - ".join(four)]
    area, mid, line = digits(3), digits(3), digits(4)
    if area[0] == "0":
        area = "2" + area[1:]
    plain = [f"+1 ({area}) {mid}-{line}", f"+1{area}{mid}{line}", f"+1-{area}-{mid}-{line}"]
    return plain, [f"({area}) {mid}-{line}", f"{area}-{mid}-{line}", f"{area} {mid} {line}", f"{area}.{mid}.{line}", f"1-{area}-{mid}-{line}", f"{area}{mid}{line}", f"{mid}-{line}", f"({area})\n{mid}-{line}"]


_CUES = (
    "order invoice ref id no isbn issue part item code total page".split(),
    "mail email write contact address".split(),
    "ip host server from address".split(),
    "card visa paid account number".split(),
    "phone call tel mobile fax number contact".split(),
)


def _decoy(rng) -> str:
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda x: x[int(rng.integers(len(x)))]
    year = int(rng.integers(1900, 2030))
    return pick([
        digits(int(rng.integers(4, 12))), digits(10), digits(7), f"{digits(4)} {digits(4)}", f"{digits(4)}-{digits(4)}-{digits(4)}", digits(16), f"{year}", f"{year}-0{digits(1)}-1{digits(1)}", f"{year}-{year + 1}",
        f"{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(5)}.{digits(4)}", f"1{digits(1)}.0{digits(1)}.{year}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(2)} {digits(3)} {digits(3)}", f"{int(rng.integers(1, 9))}.{digits(1)}.{digits(2)}.{digits(4)}",
        f"{digits(3)}-{digits(2)}-{digits(2)} {digits(3)}", f"={digits(9)}", f'"{digits(12)}"', f"{pick(_FILL)}@{digits(4)}", f"{pick(_FILL)} at {pick(_FILL)}.{pick(_FILL)}",
    ])


def made(rng, n: int):
    """(text, [(start, end, label)]): n generated texts with entities of all kinds, in plain and hidden forms, and with other numbers.

    A hidden form that a cue or a plain form of the same entity doesn't explain is rare, as what it is can't be told.
    """
    pick = lambda x: x[int(rng.integers(len(x)))]
    for _ in range(n):
        parts: list[tuple[str, int]] = []
        for kind in rng.permutation([1, 2, 3, 4])[: int(rng.integers(0, 3))].tolist():
            plain, hidden = _forms(rng, kind)
            cue = f"{pick(_CUES[kind])}{pick([' ', ': '])}"
            for _ in range(int(rng.integers(1, 3))):
                x = rng.random()
                if x < 0.45:
                    parts += [(pick(plain), kind), (pick(hidden), kind)]
                elif x < 0.6:
                    parts.append((pick(plain), kind))
                else:
                    parts.append((cue + pick(hidden), kind))
        for _ in range(int(rng.integers(0, 4))):
            decoy = _decoy(rng)
            parts.append((f"{pick(_CUES[0])} {decoy}" if rng.random() < 0.5 else decoy, 0))
            if rng.random() < 0.2:
                parts.append((decoy, 0))
        text, spans = "", []
        for i in rng.permutation(len(parts)).tolist():
            text += " ".join(pick(_FILL) for _ in range(int(rng.integers(1, 7)))) + pick([" ", " ", ", ", ". "])
            spans.append((len(text), len(text) + len(parts[i][0]), parts[i][1]))
            text += parts[i][0] + pick([" ", " ", ", ", ". ", "; "])
        yield text, spans


@lru_cache(1)
def field(seed: int = 11, texts: int = 2000, steps: int = 120, rate: float = 0.3) -> Field:
    """All weights trained together: the likelihood's gradients come from the messages over all texts, as one graph."""
    rng = np.random.default_rng(seed)
    k, names, rows, y, seen, edges = len(LABELS), {}, [], [], [], []
    for text, spans in made(rng, texts):
        base = len(y)
        tokens = _tokens(text, base_spans(text))
        for s, e, fixed in tokens:
            label = next((c for a, b, c in spans if a < e and s < b), 0) if fixed is None else fixed
            rows.append([] if fixed is not None else [names.setdefault(f, len(names)) for f in _features(text, s, e)])
            y.append(label)
            seen.append(fixed is not None)
        edges += [(base + a, base + b, c) for a, b, c in _edges(text, tokens)]
    y, seen, one = np.array(y), np.array(seen), np.eye(k)[y]
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.concatenate([np.array(r, np.int64) for r in rows])
    often = np.bincount(which, minlength=len(names)) >= 3
    of, which = of[often[which]], which[often[which]]
    w, edge = np.zeros((len(names), k)), np.zeros((3, k, k))
    square_w, square_e = np.full_like(w, 1e-4), np.full_like(edge, 1e-4)
    messages = Messages(edges)
    truth = np.zeros_like(edge)
    np.add.at(truth, (messages.kind, y[messages.a], y[messages.b]), 1)
    observed = np.where(one > 0, 0.0, _OFF)
    for _ in range(steps):
        local = np.zeros((len(y), k))
        np.add.at(local, of, w[which])
        local[seen] = observed[seen]
        table = np.exp(edge)
        for _ in range(3):  # from where they were in the step before
            messages.step(local, table, 0.8)
        apart = _soft(messages.beliefs(local)) - one
        g = np.zeros_like(w)
        np.add.at(g, which, apart[of])
        g = g / len(y) + 5e-5 * w
        expected = np.zeros_like(edge)
        np.add.at(expected, messages.kind, messages.pairs(local, table))
        h = (expected - truth) / len(y)
        h = (h + h.transpose(0, 2, 1)) / 2 + 5e-5 * edge
        square_w += g * g
        square_e += h * h
        w -= rate * g / np.sqrt(square_w)
        edge -= rate * h / np.sqrt(square_e)
    return Field({f: w[i] for f, i in names.items() if often[i]}, edge)


def all_spans(text: str, base: list[tuple[int, int, str]], model: Field) -> list[tuple[int, int, str]]:
    """The base spans and those that the field adds."""
    if not _DIGIT.search(text) and "@" not in text and not _AT.search(text):
        return base
    tokens = _tokens(text, base)
    if all(t[2] is not None for t in tokens):
        return base
    out = list(base)
    for (s, e, seen), p in zip(tokens, model.marginals(text, tokens)):
        best = int(p.argmax())
        if seen is None and best and p[best] >= SURE:
            out.append((s, e, LABELS[best]))
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def found(docs: DataFrame) -> DataFrame:
    """For docs(doc_id, text): the counts of all spans by kind, the base spans' checksum, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(field())

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                spans = all_spans(text, base, model) if text else []
                for i, kind in enumerate(KINDS):
                    out[i].append(sum(k == kind for _, _, k in spans))
                out[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out[5].append(_joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), *(pa.array(x, pa.string()) for x in out[4:])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def hidden(text: str, spans) -> str:
    """text with every span, or run of overlapping spans, as the first one's kind in brackets."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """docs with the personal data in `text` replaced by its kind, and n_chars, if there, brought up to date."""
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(field())

    def run(batches):
        import pyarrow as pa

        model, i = shared.value, columns.index("text")
        for batch in batches:
            texts = [hidden(t, all_spans(t, base_spans(t), model)) if t else t for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
