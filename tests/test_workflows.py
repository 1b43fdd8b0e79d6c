"""Readers, turns and both workflows, end to end on small exports."""

import csv
import json
import os
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from threadloom.operators import render, turns
from threadloom.plans import export
from threadloom.plans.layout import Layout
from threadloom.sources import flat_json, registry, tree_json

MD = "# Gemini Chat Export\n\n> Exported on: 2026/5/13 15:00:00\n\n---\n\n## \U0001f464 You\n\n{q}\n\n---\n\n## \U0001f916 Gemini\n\n{a}\n\n---\n"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode())


def messages(spark, *rows):
    return spark.createDataFrame([(0, i, s, k, t) for i, (s, k, t) in enumerate(rows)], "c long, index int, sender string, render_kind string, text string")


def test_pairs_skip_tool_use(spark):
    rows = messages(spark, ("assistant", "text", "early"), ("human", "text", "q"), ("assistant", "code", "c"), ("tool", "text", "t"), ("assistant", "text", "a"), ("assistant", "text", "late"), ("human", "text", "open"), ("system", "text", "s"))
    got = [(r.prompt, r.completion) for r in turns.pair_turns(rows, "c").orderBy("turn").collect()]
    assert got == [("q", "a"), ("open", None)]


def test_merge_keeps_places(spark):
    rows = messages(spark, ("assistant", "text", "x"), ("assistant", "text", "y"), ("human", "text", "q"), ("assistant", "text", "A"), ("assistant", "code", "c"), ("assistant", "text", "  "), ("assistant", "text", "B"), ("human", "text", "r"), ("assistant", "text", "z"))
    got = [(r["index"], r.text) for r in turns.merge_assistant_texts(rows, "c").orderBy("index").collect()]
    assert got == [(0, "x"), (1, "y"), (2, "q"), (3, "A\n\nB"), (4, "c"), (5, "  "), (7, "r"), (8, "z")]


def test_labels_and_duplicates(spark):
    rows = messages(spark, *[x for q, a in (("PCP_012_003 q", "a"), ("q", "a"), (" q ", "a\n"), ("", " "), ("r", "b")) for x in (("human", "text", q), ("assistant", "text", a))])
    pairs = turns.label_pairs(turns.dedupe_pairs(turns.pair_turns(rows, "c"), "c"), "c")
    assert [(r.label, r.prompt) for r in pairs.orderBy("turn").collect()] == [("012_003", "PCP_012_003 q"), ("000", "q"), ("001", "r")]


def test_render(spark):
    rows = messages(spark, ("human", "text", "q  "), ("assistant", "text", "# H\n\n- a"))
    title = spark.createDataFrame([(0, "T"), (1, ""), (2, "only")], "c long, name string")
    got = {r.c: r.md for r in render.render(rows, title, "c").collect()}
    assert got == {0: "# T\n\n## pcp_000\n\n**A Prompt by User**\n\nq\n\n**A Completion by LLM**\n\n# H\n\n- a\n\n---\n", 1: "\n", 2: "# only\n"}
    assert "## H" in render.render(rows, title, "c", shift=True).where("c = 0").first().md


def test_transcripts(spark, tmp_path):
    inner = "one\n---\ntwo\n```\n## \U0001f464 You\n```\n---\nend"
    write(f"{tmp_path}/2025-12-19_a_b.md", MD.format(q="q", a=inner))
    write(f"{tmp_path}/_hidden.md", "x")
    write(f"{tmp_path}/plain.md", "no markers")
    rows = {r.name: r for r in registry.parse_folder(spark, "gemini", str(tmp_path)).collect()}
    assert set(rows) == {"a b", "plain"} and rows["plain"].chat_messages == []
    conv = rows["a b"]
    assert [(m.sender, m.text) for m in conv.chat_messages] == [("human", "q"), ("assistant", inner)]
    assert (conv.created_at, conv.updated_at, conv.conv_ord) == ("2025-12-19T00:00:00+09:00", "2026-05-13T15:00:00+09:00", 0)
    assert conv.chat_messages[1].uuid == f"{conv.uuid}:0001" and len(conv.uuid) == 12


def test_trees(spark, tmp_path):
    def node(role, kind, at=None, **content):
        return {"message": {"author": {"role": role}, "create_time": at, "content": {"content_type": kind, **content}, "metadata": {}}}

    mapping = {
        "root": {"message": None}, "b": node("assistant", "text", 20.5, parts=["a", {"content_type": "image_asset_pointer", "asset_pointer": "p"}, {"text": "t"}, ""]),
        "a": node("user", "multimodal_text", 10, parts=[{"content_type": "image_asset_pointer", "asset_pointer": "i"}]), "s": node("system", "text", 1, parts=["no"]), "c": node("assistant", "code", 15, text="x=1", language="py"),
        "d": node("tool", "tether_quote", 16, text="quote", domain="d.org"), "e": node("assistant", "system_error", 17, name="oops"), "f": node("assistant", "text", 30, parts=["more"]), "g": node("assistant", "unknown", 31, text="?"),
    }
    write(f"{tmp_path}/conversations.json", "﻿" + json.dumps({"title": "T", "mapping": mapping, "id": "g1", "create_time": 1734588000.0}))
    conv = tree_json.read(spark, str(tmp_path)).first()
    got = [(m.uuid, m.sender, m.render_kind, m.text) for m in conv.chat_messages]
    assert got == [("a", "human", "image_ref", "[image: i]"), ("c", "assistant", "code", "x=1"), ("d", "tool", "search_result", "quote"), ("e", "assistant", "system_error", "oops"), ("b", "assistant", "text", "a\n[image: p]\nt\n\nmore")]
    assert conv.created_at == "2024-12-19T06:00:00+00:00" and conv.chat_messages[4].created_at == "1970-01-01T00:00:20.500000+00:00"
    assert conv.chat_messages[1].extra.language == "py" and conv.chat_messages[2].extra.source_domain == "d.org"


def flat(*convs):
    return json.dumps([{"uuid": u, "name": n, "created_at": "2025-01-02", "updated_at": at, "chat_messages": [{"uuid": f"{u}{i}", "sender": s, "text": t} for i, (s, t) in enumerate(ms)]} for u, n, at, ms in convs])


def test_flat(spark, tmp_path):
    write(f"{tmp_path}/b.json", flat(("c1", "T", "x", [("human", "q"), (None, "a")])))
    write(f"{tmp_path}/a.json", flat(("c0", None, "x", [])))
    rows = flat_json.read(spark, str(tmp_path)).orderBy("conv_ord").collect()
    assert [(r.uuid, r.name, len(r.chat_messages)) for r in rows] == [("c0", "", 0), ("c1", "T", 2)]
    write(f"{tmp_path}/c.json", '{"uuid": "x"}')
    with pytest.raises(Exception, match="not an array"):
        flat_json.read(spark, str(tmp_path)).collect()


def test_exports(spark, tmp_path):
    raw, base = f"{tmp_path}/raw", f"{tmp_path}/out"
    lay = Layout(base)
    turns_ = [m for k in range(3) for m in (("human", f"q{k}"), ("assistant", f"a{k}"))]
    first = [("aaaaaaaa-1", "One", "1", turns_), ("bbbbbbbb-2", "Two", "1", turns_[:2]), ("cccccccc-3", "Blank", "1", [("human", " ")])]
    write(f"{raw}/x.json", flat(*first))
    got = export.full_export(spark, "claude", raw, base, per_part=2, target=1, overflow=1)
    assert {k: got[k] for k in ("n_conversations", "n_saved", "n_skipped", "n_renamed", "n_zip_batches")} == {"n_conversations": 3, "n_saved": 2, "n_skipped": 1, "n_renamed": 2, "n_zip_batches": 2}
    assert sorted(os.listdir(lay.split_json)) == ["0000_aaaaaaaa-1.json", "0001_bbbbbbbb-2.json"]
    assert sorted(os.listdir(lay.notion_md_split)) == ["2025-01-02__One__aaaaaaaa__part01_pcp000-001.md", "2025-01-02__One__aaaaaaaa__part02_pcp002-002.md", "2025-01-02__Two__bbbbbbbb__part01_pcp000-000.md"]
    assert sorted(os.listdir(lay.zip_batches)) == ["notion_md_batch_01_002files.zip", "notion_md_batch_02_001files.zip"]
    with zipfile.ZipFile(f"{lay.zip_batches}/notion_md_batch_02_001files.zip") as z:
        assert "q0" in z.read(z.namelist()[0]).decode()
    kept = json.load(open(f"{lay.split_json}/0001_bbbbbbbb-2.json", encoding="utf-8"))
    assert kept["_source"] == {"platform": "claude"} and kept["chat_messages"][0]["content"] == [{"type": "text", "text": "q0"}]
    with open(lay.filename_mapping_csv, "rb") as f:
        raw_csv = f.read()
    assert raw_csv.startswith(b"\xef\xbb\xbfconv_id,title,created_at,old_filename,new_filename\r\n")

    counts = export.incremental_export(spark, "claude", raw, base)
    assert (counts["n_new"], counts["n_unchanged"], counts["n_skipped_empty"]) == (2, 0, 1)
    counts = export.incremental_export(spark, "claude", raw, base)
    assert (counts["n_new"], counts["n_unchanged"], counts["n_updated"]) == (0, 2, 0)
    before = export.read_snapshot(spark, lay)
    export.write_snapshot_json(before, lay.snapshot_path, "now")
    assert json.load(open(lay.snapshot_path, encoding="utf-8"))["records"]["bbbbbbbb-2"]["fingerprint"][0] == "1"
    shutil.rmtree(lay.snapshot_table)
    counts = export.incremental_export(spark, "claude", raw, base)
    assert (counts["n_new"], counts["n_unchanged"], counts["n_updated"]) == (0, 2, 0)
    write(f"{raw}/x.json", flat(("aaaaaaaa-1", "Renamed", "2", turns_), ("dddddddd-4", "Four", "1", turns_[:2])))
    counts = export.incremental_export(spark, "claude", raw, base, zip_changed=True)
    assert (counts["n_new"], counts["n_updated"], counts["n_deleted"]) == (1, 1, 1)
    assert sorted(os.listdir(lay.notion_md_renamed)) == ["2025-01-02__Four__dddddddd.md", "2025-01-02__Renamed__aaaaaaaa.md", "2025-01-02__Two__bbbbbbbb.md"]
    with open(lay.filename_mapping_csv, newline="", encoding="utf-8-sig") as f:
        assert [r["title"] for r in csv.DictReader(f)] == ["Renamed", "Four", "Two"]
    assert os.listdir(lay.zip_batches_diff)


def test_file_sha1(spark, tmp_path):
    """Empty files count, names are whole, and a file that goes alone keeps its place beside others."""
    import hashlib

    from threadloom.sources import files

    want = {"a.txt": b"", "b c+%20.txt": b"x", "d.bin": bytes(range(256)) * 20_000, "e.txt": "é\U0001f464".encode(), "f.txt": b""}
    for name, raw in want.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "_hidden.txt").write_bytes(b"h")
    (tmp_path / "folder.txt").mkdir()
    found = lambda *a: {r.file_name: r.sha1 for r in files.file_sha1(spark, str(tmp_path), *a).collect()}
    assert found() == {n: hashlib.sha1(raw).hexdigest() for n, raw in want.items()}
    assert set(found("*.{bin,zip}")) == {"d.bin"} and set(found("[^a-e].txt")) == {"f.txt"}


def test_file_sha1_of_odd_documents(spark, tmp_path):
    """Null, empty and repeated documents give the rows of the SQL."""
    import duckdb

    from threadloom.plans import catalog, workflow_catalog

    rows = [(0, None), (1, ""), (2, "x"), (2, "y"), (2, "y"), (2, ""), (100_000_000, "z")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = workflow_catalog.file_sha1(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.ORACLE["file_sha1"]).fetchall())


def test_collisions(spark):
    from threadloom.operators import mapping

    rows = spark.createDataFrame([(0, "a", "s"), (1, "b", "s"), (2, "a", "s"), (3, "", "s"), (4, None, "s"), (5, "c", "t")], "conv_ord long, uuid string, stem string")
    got = [(r.final_stem, r.n_collisions) for r in mapping.resolved(rows).orderBy("conv_ord").collect()]
    assert got == [("s", 0), ("s_2", 1), ("s", 0), ("s_3", 2), ("s_4", 3), ("t", 0)]


def test_clean_folder(spark, tmp_path):
    write(f"{tmp_path}/a.md", "x $$y$$\n")
    write(f"{tmp_path}/b.md", "fine\n")
    assert export.clean_folder(spark, str(tmp_path)) == {"files": 2, "unsupported_removed": 0, "block_math_converted": 1}
    assert open(f"{tmp_path}/a.md").read() == "x `y`\n"


def test_clean_folder_by_shares(spark, tmp_path):
    """Shares bound the number of tasks, and names stay off the driver; files that are empty, hidden or long are cleaned too."""
    from threadloom.sources import files

    want = {f"{i:05d}.md": "fine\n" for i in range(2_500)} | {"empty.md": "\n", "_hidden.md": "`y`\n", "long.md": "a\n" * 2_000_000 + "`y`\n"}
    for name, text in want.items():
        write(f"{tmp_path}/md/{name}", text.replace("`y`", "$$y$$") if name != "empty.md" else "")
    tasks = files.with_contents(files.listed(spark, f"{tmp_path}/md"), f"{tmp_path}/md").rdd.getNumPartitions()
    assert 3 <= tasks <= 6
    assert export.clean_folder(spark, f"{tmp_path}/md") == {"files": 2_503, "unsupported_removed": 0, "block_math_converted": 2}
    assert {n: open(f"{tmp_path}/md/{n}", encoding="utf-8", newline="").read() for n in os.listdir(f"{tmp_path}/md")} == want
    write(f"{tmp_path}/bad/a.md", "x")
    with open(f"{tmp_path}/bad/a.md", "wb") as f:
        f.write(b"\xff")
    with pytest.raises(Exception, match="(?i)utf"):
        export.clean_folder(spark, f"{tmp_path}/bad")
    os.makedirs(f"{tmp_path}/none")
    assert export.clean_folder(spark, f"{tmp_path}/none") == {"files": 0, "unsupported_removed": 0, "block_math_converted": 0}


def test_stream(spark, tmp_path):
    from threadloom.streaming.incremental import watch

    raw, base, seen = f"{tmp_path}/raw", f"{tmp_path}/out", []
    write(f"{raw}/x.json", flat(("aaaaaaaa-1", "One", "1", [("human", "q"), ("assistant", "a")])))
    watch(spark, "claude", raw, base, f"{tmp_path}/cp", lambda n, r: seen.append(r["n_new"])).awaitTermination()
    assert seen == [1]


def test_fingerprint_is_json_dumps(spark):
    import hashlib

    from threadloom.operators import diff

    texts = ['a "b" \\ c', "tab\tnew\nline\x1f\x00", "日本 😀", "", None]
    rows = spark.createDataFrame([(0, i, "human", t, f"m{i}") for i, t in enumerate(texts)], "c long, index int, sender string, text string, uuid string")
    want = json.dumps([{"index": i, "sender": "human", "text": t, "uuid": f"m{i}"} for i, t in enumerate(texts)], ensure_ascii=False, sort_keys=True)
    assert diff.fingerprints(rows, "c").first().fingerprint == hashlib.sha1(want.encode()).hexdigest()
    nested = rows.groupBy("c").agg(F.collect_list(F.struct("index", "sender", "text", "uuid")).alias("m"))
    assert nested.select(diff.fingerprint_of(F.col("m"))).first()[0] == hashlib.sha1(want.encode()).hexdigest()


def test_exports_read_folders_by_shares(spark, tmp_path):
    """Scans of many files have few tasks, whole folders are counted, and conversations keep the order of their files' names."""
    from threadloom.sources import files, sinks

    n = 1_200
    for i in range(n):
        write(f"{tmp_path}/raw/f{n - i:04d}.json", flat((f"u{n - i:04d}", "T", "1", [("human", "q")]), (f"v{n - i:04d}", "T", "1", [])))
    rows = registry.parse_folder(spark, "claude", f"{tmp_path}/raw")
    assert rows.rdd.getNumPartitions() <= 4
    got = [(r.conv_ord, r.uuid) for r in rows.select("conv_ord", "uuid").orderBy("conv_ord").collect()]
    assert got == [(2 * i + k, f"{'uv'[k]}{i + 1:04d}") for i in range(n) for k in range(2)]
    write(f"{tmp_path}/raw/g.json", "")
    assert sinks.listed(spark, f"{tmp_path}/raw").count() == n + 1
    with pytest.raises(Exception, match="not an array"):
        registry.parse_folder(spark, "claude", f"{tmp_path}/raw").collect()
    assert files.listed(spark, f"{tmp_path}/raw").agg(F.max("share")).first()[0] == 1


def test_texts_are_written_from_the_batch(spark, tmp_path):
    """A task's Python holds a batch once: no copies of its texts, which as str take four bytes a character here."""
    from threadloom.sources import sinks

    seen = []
    rows = spark.range(0, 8, 1, 1).select(F.format_string("%d.txt", "id").alias("file_name"), F.concat(F.lit("\U0001f464"), F.repeat(F.lit("x"), 4_000_000)).alias("text"))
    assert sinks.write_texts(rows, f"{tmp_path}/out") == 8

    class Rows:
        """Runs what a task would run, here, over one batch."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            import tracemalloc

            batch = rows.toArrow().combine_chunks().to_batches()[0]
            tracemalloc.start()
            list(run([batch]))
            seen.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            return rows.select(F.lit(8).alias("n"))

    sinks.write_texts(Rows(), f"{tmp_path}/again")
    assert sorted(os.listdir(f"{tmp_path}/again")) == [f"{i}.txt" for i in range(8)]
    assert (tmp_path / "again/7.txt").read_bytes() == (tmp_path / "out/7.txt").read_bytes() == ("\U0001f464" + "x" * 4_000_000).encode()
    assert seen[0] < 4_000_000
