"""Operators 2, 5, 6, 7, 8 and 10 against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import mixing, packing, pii, shingles, suffixes, toxicity
from threadloom.llm.common import bloom, components, in_bloom

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Documents with an extra column whose name clashes with the operators' own."""
    rows = [(i, t, "en", s, len(t or ""), "x") for i, t, s in rows]
    return spark.createDataFrame(rows, DOCS + ", `key` string")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=80))
    base = [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(n)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t, f"s{i % 3}"))
        if i % 4 == 0:
            rows.append((1000 + i, t, "s0"))
        if i % 5 == 0 and t:
            w = t.split()
            w[rng.randrange(len(w))] = "edited"
            rows.append((2000 + i, " ".join(w), "s0"))
        if i % 6 == 0:
            rows.append((3000 + i, t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :], "s1"))
    rows += [(5000, None, None), (5001, "", "s0"), (5002, " \t\n", None), (5003, "a b", "s2"), (5004, "A B", "s2"), (5005, "z" * 3000, "big"), (5006, "y" * 450, "big"), (5007, "one", "s0"), (None, "null id here", "s1"), (None, None, "s1"), (7, base[7], "s1"), (7, base[7], "s1")]
    return rows


ROWS = corpus()


def set_of(text, n=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_links(rows):
    sets = [set_of(t) for _, t, _ in rows]
    near = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 90 * len(sets[a] | sets[b]):
                near[a].append(b)
                near[b].append(a)
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, bs in enumerate(near):
        for b in bs:
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least[i] = min(ids) if ids else None
    return sets, near, least


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is not None, v if v is not None else 0) for v in r])


def test_jaccard(spark):
    sets, near, least = brute_links(ROWS)
    want = [(r[0], len(s), len(b), least[i]) for i, (r, s, b) in enumerate(zip(ROWS, sets, near))]
    got = shingles.similar(table(spark, ROWS)).select("doc_id", "n_shingles", "n_similar", "component_id").collect()
    assert ordered(map(tuple, got)) == ordered(want)


def test_jaccard_splits_hubs_and_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(shingles, "CELL", 2)
    monkeypatch.setattr(shingles, "HOT", 7)
    monkeypatch.setattr(shingles, "CELL_BYTES", 5000)
    rng = random.Random(2)
    base = [f"t{k}" for k in range(200)]
    rows = [(i, " ".join(base[: 100 + i // 8] + [f"u{rng.random()}"]), "s") for i in range(60)]
    sets, near, least = brute_links(rows)
    got = shingles.similar(table(spark, rows)).select("doc_id", "n_similar", "component_id").collect()
    assert ordered(map(tuple, got)) == [(i, len(near[i]), least[i]) for i in range(60)]


def test_jaccard_dedup(spark):
    docs = table(spark, ROWS).withColumn("_key", F.lit("clash")).withColumn("_w", F.lit(1))
    kept = shingles.deduplicated(docs)
    assert kept.columns == docs.columns
    _, _, least = brute_links(ROWS)
    groups = collections.defaultdict(set)
    for i, r in enumerate(ROWS):
        groups[least[i] if set_of(r[1]) else ("blank", i)].add(i)
    got = kept.collect()
    assert len(got) == len(groups)
    assert len({set_of(r.text) for r in got if set_of(r.text)}) == sum(bool(set_of(r.text)) for r in got)


def brute_removed(rows, length):
    seen = collections.Counter(b[i : i + length] for _, t, _ in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4000, 1])
def test_suffixes(spark, hot):
    rows = [*ROWS, (6000, "é" * 300 + ROWS[0][1], "s"), (6001, "x" + "é" * 150, "s"), (6002, "ab" * 200, "s"), (6003, "abc" * 20_000, "s"), (6004, "x" * 50_000, "s")]
    got = suffixes.removed(table(spark, rows), hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(map(tuple, got)) == ordered(brute_removed(rows, 200))


def test_texts_whose_keys_agree(spark, monkeypatch):
    """Where two texts had one key, both would count as copies of each other."""
    whole = F.xxhash64
    monkeypatch.setattr(suffixes.F, "xxhash64", lambda *c: whole(*c) % 7 if isinstance(c[0], str) and c[0] == "text" else whole(*c))
    rows = [(i, f"{i} " * 200, "s") for i in range(30)] + [(40, "5 " * 200, "s")]
    got = suffixes.removed(table(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(map(tuple, got)) == ordered(brute_removed(rows, 200))


def test_merged_spans(spark):
    rng = random.Random(6)
    rows = [(k, s, s + rng.choice([200, 250, 3000])) for k in range(5) for s in rng.sample(range(3_000_000), 400)] + [(9, s, s + 200) for s in range(3000)]
    got = suffixes.merged(spark.createDataFrame(rows, "key long, start long, stop long")).collect()
    cover = lambda spans: {k: np.cumsum(np.bincount([s for x, s, _ in spans if x == k], minlength=3_100_000) - np.bincount([e for x, _, e in spans if x == k], minlength=3_100_000)) > 0 for k in (0, 4, 9)}
    assert all((a == b).all() for a, b in zip(cover(rows).values(), cover([tuple(r) for r in got]).values()))
    assert sum(r.key == 9 for r in got) == 1


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    monkeypatch.setattr(suffixes, "BLOCK", 3000)
    rng = np.random.default_rng(4)
    long = "".join(map(chr, rng.integers(97, 123, 5000)))
    raw, at = np.frombuffer((long + long[1000:3000]).encode(), np.uint8), np.array([0, 5000, 7000])
    with np.errstate(over="ignore"):
        seen = collections.defaultdict(set)
        for rows, s0, anchor, _, run, put in suffixes.anchors_of(raw, at):
            for r, s, a, n, p in zip(rows.tolist(), s0.tolist(), anchor.tolist(), run.tolist(), put.tolist()):
                for k in range(n + 1):
                    seen[(r, s + k)].add((a, p - k))
    assert set(seen) == {(0, k) for k in range(4801)} | {(1, k) for k in range(1801)}
    assert all(len(v) == 1 for v in seen.values())
    assert all(seen[(0, 1000 + k)] == seen[(1, k)] for k in range(1801))


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [*range(1, 30), 200]:
        for letters in (1, 2, 5):
            s = rng.integers(1, letters + 1, n)
            assert suffixes.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("distinct", [True, False])
def test_distributed_suffix_order(spark, distinct, monkeypatch):
    """The order across tasks is that of sorted suffixes; equal ones share a rank."""
    monkeypatch.setattr(suffixes, "RANGE", 40)
    rng = random.Random(5)
    texts = [bytes(rng.choices(range(256) if distinct else (97, 98), k=rng.randint(1, 30))) for _ in range(12)]
    texts += [] if distinct else [texts[0], texts[1][3:], b"a" * 40]
    strings = spark.createDataFrame([(i, [c + 1 for c in t]) for i, t in enumerate(texts)], "id long, c array<long>")
    got = {r.id: r.r for r in suffixes.ranked(strings, 50).collect()}
    every = sorted(t[i:] for t in texts for i in range(len(t)))
    first: dict = {}
    for k, x in enumerate(every):
        first.setdefault(x, k + 1)
    assert got == {i: [first[t[j:]] for j in range(len(t))] for i, t in enumerate(texts)}


def test_mixing(spark):
    docs = table(spark, ROWS)
    rows = mixing.mix(docs.select(F.col("doc_id").alias("key"), "source", mixing.n_words("text").alias("size")))
    got = rows.withColumn("taken", mixing.taken()).collect()
    again = rows.withColumn("taken", mixing.taken()).collect()
    key = lambda r: (r.key is not None, r.key or 0, r.before, r.source or "")
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert len(got) == len(ROWS)
    sizes = collections.Counter()
    for _, t, s in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    left, free, target = float(sum(sizes.values())), {s: (1, 2, 3)[i % 3] for i, s in enumerate(names) if sizes[s]}, dict.fromkeys(names, 0.0)
    while free:
        over = [s for s in free if left * free[s] / sum(free.values()) > 3 * sizes[s]]
        if not over:
            target |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free = {s: w for s, w in free.items() if s not in over}
        left = sum(sizes.values()) - sum(target[s] for s in names if s not in free)
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(target[s]) for r in mine)
        assert sum(r.taken for r in mine) == pytest.approx(target[s], abs=2 * mixing.PACKET)
        before = sorted((r.before, r.size) for r in mine if r.size)
        assert all(b == sum(n for _, n in before[:i]) for i, (b, _) in enumerate(before))
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    queue = mixing.schedule(rows.drop("served")).collect()
    assert [r.finish for r in queue] == sorted(r.finish for r in queue) and len({r.range for r in queue}) > 1
    served, budget = collections.Counter(), sum(sizes.values())
    for r in queue:
        served[names[r.k]] += min(r.words, budget)
        budget -= min(r.words, budget)
    assert {s: n for s, n in served.items() if n} == {s: n for s in names if (n := sum(r.taken for r in got if r.source == s))}
    assert sum(r.taken for r in got) == sum(sizes.values())
    assert key(got[0])


def test_mixing_sql_with_capped_sources(spark, tmp_path):
    import duckdb

    table(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = [tuple(r) for r in con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.ORACLE})").fetchall()]
    got = [tuple(r) for r in mixing.op2_mix(spark, str(tmp_path)).collect()]
    assert ordered(r[:3] + r[4:] for r in got) == ordered(r[:3] + r[4:] for r in want)
    assert ordered(r[3:4] for r in got) == [(pytest.approx(x),) for (x,) in ordered(r[3:4] for r in want)]


def test_mixed_rows(spark):
    docs = table(spark, ROWS)
    docs = docs.unionByName(docs.where("doc_id = 7").withColumn("lang", F.lit("other")))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    plan = mixing.mix(docs.select(F.xxhash64(*docs.columns).alias("key"), "source", mixing.n_words("text").alias("size")))
    taken = {r.source: r.n for r in plan.groupBy("source").agg(F.sum(mixing.taken()).alias("n")).collect() if r.n}
    mine = collections.Counter()
    for r in rows:
        mine[r.source] += len(WORD.findall(r.text))
    assert mine == taken
    whole = {t for _, t, _ in ROWS}
    assert all(r.text in whole or any(t and t.startswith(r.text) for t in whole) for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [*ROWS, (8000, "word " * 5000, "s"), (8001, "<|endoftext|> x", "s"), (8002, "日本語 😀 \r\n\t ''s", "s")]
    path = packing.public_path()
    got = packing.packed(packing.token_pieces(table(spark, rows), path)).collect()
    own = Tokenizer.from_file(path)
    want = []
    for i, t, _ in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        want += [(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))]
    assert ordered(tuple(r)[:5] for r in got) == ordered(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 1024
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 1024 + 1


def test_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.put(n)[0] for n in (6, 7, 5, 4, 5)] == [0, 1, 2, 0, 2]
    assert bins.closed == 1
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(2050) == [(0, 2), (2, 1024), (1026, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)]


def test_bound_binds_on_documents():
    import pyarrow.parquet as pq

    if not os.path.isdir(SF):
        pytest.skip("the driver's tables aren't here")
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist()
    sizes = [n for ids in packing.encoder(packing.public_path())(t or "" for t in texts) for _, n in packing.cut(len(ids) + 1)]
    bins = packing.Bins()
    for n in sizes:
        bins.put(n)
    assert bins.closed > 0 and bins.open == packing.OPEN_BINS
    assert bins.made <= 1.05 * sum(sizes) / 1024 + 10


def brute_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans():
    rng = random.Random(1)
    bits = ["@", ".", "a", "-", "1", "0", "+", "(", " ", "2", "555-1234", "4111111111111111", "255.", "x@y.z", "é", "_"]
    for _ in range(20_000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 24)))
        assert pii.base_spans(text) == brute_spans(text), text
    for big in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + "(" * 300_000, "1 " * 150_000):
        pii.all_spans(big, pii.base_spans(big), pii.field())


def test_field_adds_what_repeats(spark):
    text = "write to a.b@mail.org or +1 (988) 555-2485, later 988-555-2485; order 12345678, 2019-03-12."
    rows = [*ROWS, (9000, text, "s"), (9001, "x 10.0.0.1, 4111 1111 1111 1111", "s")]
    got = {r.doc_id: r for r in pii.found(table(spark, rows)).collect()}
    assert len(pii.found(table(spark, rows)).collect()) == len(rows)
    one = got[9000]
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 0, 0, 2)
    joined = ",".join(f"{k}:{s}:{e}" for s, e, k in brute_spans(text))
    assert one.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) < set(one.spans.split(","))
    assert got[5000].spans == "" and got[5000].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r for r in pii.masked(table(spark, rows)).collect()}
    assert masked[9001].text == "x [IP], [CARD]" and masked[9001].n_chars == len(masked[9001].text) and masked[5000].text is None
    assert "988" not in masked[9000].text


def test_field_on_held_out_texts():
    """Spans of all kinds that the patterns miss, in texts from another seed: all but surely right, and most found."""
    model, right, hit, all_ = pii.field(), [], collections.Counter(), collections.Counter()
    for text, spans in pii.made(np.random.default_rng(99), 400):
        base = pii.base_spans(text)
        got = set(pii.all_spans(text, base, model))
        assert set(base) <= got
        want = [(a, b, pii.LABELS[k]) for a, b, k in spans if k and not any(s < b and a < e for s, e, _ in base)]
        right += [any(a < e and s < b and k == kind for a, b, kind in want) for s, e, k in got - set(base)]
        for a, b, kind in want:
            all_[kind] += 1
            hit[kind] += any(s < b and a < e and k == kind for s, e, k in got)
    assert sum(right) >= 0.98 * len(right)
    assert all(hit[k] >= 0.85 * all_[k] and all_[k] > 50 for k in pii.KINDS), (hit, all_)


def test_skip_edges_carry_labels():
    """What one mention shows holds for an equal one far away; without it, the number stays what it is."""
    model = pii.field()
    far = " and the text goes on 2019 with 12345678 more" * 30
    spans = lambda t: [t[s:e] for s, e, k in pii.all_spans(t, pii.base_spans(t), model) if (s, e, k) not in pii.base_spans(t)]
    assert spans("some 9885552485 there" + far) == []
    assert spans("+1 (988) 555-2485 here" + far + " some 9885552485 there") == ["9885552485"]
    assert spans("tel: 988-555-2485 988-555-2486") == ["988-555-2485", "988-555-2486"]
    assert spans("password=38f562f65ac2ae8d8e token = \"c354a4b3fd593d2b\" 1998") == []
    text = "call 988-555-2485 or 988-555-2486, a@x.org, b@x.org and +1 (988) 555-2485"
    kinds = collections.Counter(k for _, _, k in pii._edges(text, pii._tokens(text, pii.base_spans(text))))
    assert kinds[0] == 4 and kinds[1] == 1 and kinds[2] >= 2
    long = " ".join(["988-555-2485"] * 3000 + ["4111.1111.1111.1111"] * 3000)
    assert len(pii.all_spans(long, pii.base_spans(long), model)) >= 0


def toxic_rows(n=1500, seed=9):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    bad = ["vilexx", "groszzq", "hatredy"]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(5, 120))
        y = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 4) * y):
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", ".", "en"])
        docs.append((i, " ".join(w), ["en", "de"][i % 2], "s", 0))
        labels.append((i, 0, y))
    return docs, labels


def test_toxicity_on_held_out(spark):
    docs, labels = toxic_rows()
    docs = spark.createDataFrame(docs + [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "x", "en", "s", 1)], DOCS)
    truth = dict((i, y) for i, _, y in labels)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.scored(docs, model).withColumn("held", toxicity.held_out("doc_id")).collect()
    assert len(got) == len(truth) + 3 and all(0 <= r._score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id in truth]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    right = sum((r._score >= 0.3) == bool(truth[r.doc_id]) for r in held)
    assert right / len(held) > 0.95
    assert next(r for r in got if r.doc_id == 5001)._score < 0.3
    alone = toxicity.scored(docs.where("doc_id = 3").withColumn("lang", F.lit("zz")), model).first()._score
    assert alone == pytest.approx(next(r for r in got if r.doc_id == 3)._score, abs=1e-6)


def test_toxicity_without_labels(spark):
    docs = table(spark, ROWS[:5])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    assert {r._score for r in toxicity.scored(docs, model).collect()} == {0.0}


def test_toxicity_thresholds_by_language():
    """A language whose scores lie elsewhere gets its own threshold; one with no labels that of all."""
    rng = np.random.default_rng(0)
    rows, score = [], []
    for i in range(2000):
        y = int(rng.random() < 0.3)
        lang = ["a", "b"][i % 3 == 0]
        score.append((0.65 if lang == "b" else 0.2) + 0.15 * y + 0.1 * rng.random())
        rows.append((np.full((3, 3), 1 << toxicity.ROW_BITS, np.int32), y, lang))
    rows[0] = (*rows[0][:2], None)
    at = iter(score)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity.Model, "fit", lambda *a: None)
        m.setattr(toxicity.Model, "scores", lambda *a: np.array([next(at)]))
        model = toxicity.fitted(rows, (1400, 600))
    assert model.thresholds["a"] == 0.3 and model.thresholds["b"] == 0.8
    assert set(model.thresholds) == {"a", "b", None}


def test_toxicity_cleans_and_handles_cases(spark):
    docs, labels = toxic_rows(600)
    docs = spark.createDataFrame([(*r, "x") for r in docs] + [(0, docs[0][1], "en", "s", 0, "y")] * 3 + [(None, None, None, None, None, None)], DOCS + ", _score string")
    labels = spark.createDataFrame(labels + labels[:50] + [(None, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, positives=60, negatives=100)
    scored, kept = toxicity.scored(docs, model), toxicity.cleaned(docs, model)
    assert scored.columns == ["doc_id", "text", "lang", "source", "n_chars", "_score", "_threshold"] and kept.columns == docs.columns
    assert kept.count() == scored.where("_score < _threshold").count() < docs.count() == scored.count()
    assert scored.where("text is null").count() == kept.where("text is null").count() == 1
    empty = docs.limit(0)
    assert toxicity.scored(empty, model).count() == toxicity.cleaned(empty, model).count() == 0
    assert toxicity.train(empty, labels).constant is not None


def test_toxicity_learns_from_every_label(spark):
    """A word that only the last of 5,000 toxic and 10,000 clean documents have, by hash, is learned."""
    ids = [r.id for r in spark.range(20_000).where(~toxicity.held_out("id")).orderBy(F.xxhash64("id"), "id").collect()]
    docs = [(i, f"plain words{i % 50} here{i % 7}" + (" vilexx" if k < 12_300 else " groszzq") * (k % 3 == 0), "en", "s", 0) for k, i in enumerate(ids)]
    labels = [(i, 0, int(k % 3 == 0)) for k, i in enumerate(ids)]
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    new = spark.createDataFrame([(1, f"plain words3 {w}", "en", "s", 0) for w in ("here3", "vilexx", "groszzq")], DOCS)
    assert [r._score >= 0.3 for r in toxicity.scored(new, model).collect()] == [False, True, True]


@pytest.mark.parametrize("calibrated", [True, False])
def test_toxicity_by_shards(spark, monkeypatch, calibrated):
    """Many shards learn as one does, whatever the layout, from each labelled document once."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 300)
    rows, labels = toxic_rows()
    truth = {i: y for i, _, y in labels}
    docs = spark.createDataFrame(rows + rows[:40] + [(3, rows[3][1] + " longer", "en", "s", 0), (5000, "no label", "en", "s", 0), (None, None, None, None, None)], DOCS)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    used = labels.where(~toxicity.held_out("doc_id"))
    got = toxicity._labelled(docs.select("doc_id", "text", "lang"), used.select("doc_id", "toxic"), 1500, 3, calibrated)
    apart = got.withColumn("p", F.spark_partition_id()).select("p", "shard").distinct().collect()
    assert {r.p for r in apart} == {r.shard for r in apart} == {0, 1, 2} and len(apart) == 3
    got = got.collect()
    assert sorted((r.text, r.toxic) for r in got) == sorted((rows[r.doc_id][1], r.toxic) for r in used.collect())
    assert any(r.rest for r in got) == calibrated
    models = [toxicity.train(d, labels, calibrated=calibrated) for d in (docs.repartition(3), docs.coalesce(1))]
    assert (models[0].table == models[1].table).all() and models[0].thresholds == models[1].thresholds
    assert set(models[0].thresholds) == ({"en", "de"} if calibrated else set())
    held = toxicity.scored(docs.where(toxicity.held_out("doc_id")), models[0]).where("doc_id < 1500").collect()
    assert sum((r._score >= 0.3) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.95
    clean = labels.withColumn("toxic", F.lit(0))
    assert toxicity.train(docs, clean, calibrated=calibrated).constant == 0


def test_toxicity_pools_long_texts_in_windows(monkeypatch):
    rng = np.random.default_rng(3)
    model = toxicity.Model()
    lengths = [2, 40, 3, 5, 9, 2, 17, 8]
    stops = np.cumsum(lengths)
    starts = stops - lengths
    ids = rng.integers(0, 1 << toxicity.ROW_BITS, (int(stops[-1]), 3))
    top, where = model.pooled(ids, starts, stops)
    for window in (1, 4, 7, 16):
        monkeypatch.setattr(toxicity, "WINDOW", window)
        some, place = model.pooled(ids, starts, stops)
        assert np.allclose(some, top) and (place == where).all()


def test_empty_tables(spark):
    docs = table(spark, []).limit(0)
    assert shingles.similar(docs).count() == 0
    assert shingles.deduplicated(docs).count() == 0
    assert suffixes.removed(docs).count() == 0
    assert pii.found(docs).count() == 0 and pii.masked(docs).count() == 0
    assert packing.packed(packing.token_pieces(docs, packing.public_path())).count() == 0
    assert mixing.mix(docs.select(F.col("doc_id").alias("key"), "source", mixing.n_words("text").alias("size"))).count() == 0
    assert mixing.mixed(docs).count() == 0


def test_components_of_chains(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(500, k) for k in range(501, 700)] + [(1, 1), (None, 3)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == (i - 1) // 50 * 50 + 1 for i in range(1, 200)) and all(got[k] == 500 for k in range(500, 700))


def test_components_of_a_long_chain(spark):
    ids = random.Random(4).sample(range(-(10**15), 10**15), 2000)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long").repartition(6)
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == dict.fromkeys(ids, min(ids))


def test_bloom(spark):
    keys = spark.range(0, 4000, 2).select(F.col("id").alias("key"))
    words = bloom(keys, 18)
    hit = in_bloom(words, np.arange(4000))
    assert hit[::2].all() and hit[1::2].mean() < 0.05
