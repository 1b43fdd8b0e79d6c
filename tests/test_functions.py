"""Column expressions against plain Python statements of the same rules."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.functions import markdown as md
from threadloom.functions import names
from threadloom.functions import pytext
from threadloom.operators import batches, parts


def column(spark, values, **columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    got = rows.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()
    return [tuple(r)[1:] for r in got]


def texts(symbols, most, n=1500, seed=3):
    rng = random.Random(seed)
    few = ["".join(x) for k in range(3) for x in itertools.product(symbols, repeat=k)]
    return few + ["".join(rng.choices(symbols, k=rng.randint(3, most))) for _ in range(n)]


def test_strip_and_lines_are_pythons(spark):
    odd = ["\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1e", "\x1f", "\x85", "\xa0", " ", " ", " ", "　", " ", "x", "​", "y z"]
    values = texts(odd, 7)
    got = column(spark, values, a=pytext.strip("v"), b=pytext.rstrip("v"), c=pytext.splitlines("v"), d=pytext.is_blank("v"))
    for v, (a, b, c, d) in zip(values, got):
        assert (a, b, c, d) == (v.strip(), v.rstrip(), v.splitlines(), not v.strip())


def shifted(text):
    out, inside = [], False
    for x in text.splitlines():
        if re.match(r"\s*(```|~~~)", x):
            inside = not inside
        elif not inside and (m := re.match(r"(#+)[ \t]+(.*)", x)) and len(m[1]) < 7:
            level, t = len(m[1]) + 1, m[2]
            x = "#" * level + " " + t if level <= 3 else f"**{t.strip()}**" if t.strip() else ""
        out.append(x)
    return "\n".join(out)


def test_shift_headings(spark):
    values = texts(["# A", "## B", "### C ", "####### D", "#### ", "```py", " ~~~", "\n", "\n\n", "t"], 9)
    assert [x for (x,) in column(spark, values, a=md.shift_headings("v"))] == [shifted(v) for v in values]


def unsupported(text):
    lines, out, n, i = text.splitlines(), [], 0, 0
    places = [k for k, x in enumerate(lines) if re.match(r"\s*```", x)]
    gone = set()
    for a, b in itertools.zip_longest(places[::2], places[1::2]):
        body = lines[a + 1 : b]
        if len(body) <= 3 and any(md.UNSUPPORTED in x for x in body):
            n += 1
            gone |= set(range(a, len(lines) if b is None else b + 1))
    return "\n".join(x for k, x in enumerate(lines) if k not in gone), n


def test_unsupported_blocks(spark):
    values = texts(["```\n", " ```x\n", md.UNSUPPORTED + " yet.\n", "a\n", "\n", "b"], 10)
    got = column(spark, values, a=md.without_unsupported("v"), b=md.count_unsupported("v"))
    assert got == [unsupported(v) for v in values]


def ruled(text):
    lines, out = text.splitlines(), []
    for k, x in enumerate(lines):
        if k and lines[k - 1].strip() and x.strip() and "---" in (x.strip(), lines[k - 1].strip()):
            out.append("")
        out.append(x)
    return "\n".join(out)


def test_rules_math_and_blanks(spark):
    values = texts(["---", " --- ", "\n", "\n\n\n", "a", "$$", " ", "x"], 9)
    got = column(spark, values, a=md.space_rules("v"), b=md.math_to_code("v"), c=md.count_block_math("v"), d=md.collapse_blanks("v"))
    for v, (a, b, c, d) in zip(values, got):
        math = re.compile("[$]{2}(.+?)[$]{2}", re.S)
        assert (a, b, c, d) == (ruled(v), math.sub(lambda m: f"`{m[1].strip()}`", v), len(math.findall(v)), re.sub("\n\n+\n", "\n\n", v))


def test_clean_switches(spark):
    text = "t $$x$$\n```\n" + md.UNSUPPORTED + "\n```\na\n---\nb\n\n\n\nc"
    on, no_math, no_blocks, no_blanks = column(spark, [text], a=md.cleaned("v"), b=md.cleaned("v", convert_block_math=False), c=md.cleaned("v", remove_unsupported=False), d=md.cleaned("v", normalize_blanks=False))[0]
    assert (on.text, on.unsupported_removed, on.block_math_converted) == ("t `x`\na\n\n---\n\nb\n\nc\n", 1, 1)
    assert "$$x$$" in no_math.text and no_math.block_math_converted == 0
    assert md.UNSUPPORTED in no_blocks.text and no_blocks.unsupported_removed == 0
    assert "a\n---\nb\n\n\n\nc\n" in no_blanks.text


@pytest.mark.parametrize(
    "title, want",
    [("hello world", "hello_world"), ("a:b*c?d", "a_b_c_d"), ('a"b<c>d|e', "a_b_c_d_e"), ("a   b", "a_b"), ("a___b", "a_b"), ("", "untitled"), (None, "untitled"), ("a" * 200, "a" * 80), ("title...", "title"), ("title   ", "title"), ("é", "\xe9"), ("　x　y", "x_y"), ("///", "untitled")],
)
def test_titles(spark, title, want):
    assert column(spark, [title], a=names.sanitize_title("v")) == [(want,)]


def test_names(spark):
    null = F.lit(None).cast("string")
    got = column(spark, ["2025-12-19T01:02:03Z", "1734588000.0", "soon", None], a=names.date_prefix(null, F.col("v"), null), b=names.date_prefix(F.lit("2025-12-19_x.md"), F.col("v"), null))
    assert got == [("2025-12-19", "2025-12-19"), ("2024-12-19", "2025-12-19"), ("undated", "2025-12-19"), ("undated", "2025-12-19")]
    ids = ["abc12345-6789-abcd", "ab-cdefgh-12345", "", None, "---"]
    assert [x for (x,) in column(spark, ids, a=names.short_id("v"))] == ["abc12345", "abcdefgh", "noid", "noid", "noid"]
    files = ["0011_0a1b2c3d-4e5f.md", "0000_abc12345def6.md", "2025-12-19__t__abc12345.md"]
    assert [x for (x,) in column(spark, files, a=names.is_legacy("v"))] == [True, True, False]
    stems = ["a__part01_pcp000-024.md", "a__part1_pcp0-1__part02_pcp3-4.md", "plain.md", "no_suffix"]
    assert [x for (x,) in column(spark, stems, a=names.original_stem(F.col("v")))] == ["a", "a__part1_pcp0-1", "plain", "no_suffix"]


def test_sizes(spark):
    values = [0, 1, 1023, 1024, 1280, 1331, 1024**2 - 1, 1024**2, 5 * 1024**3, 1024**4, 7 * 1024**5]

    def size(n):
        for unit in ("B", "KB", "MB", "GB"):
            if n < 1024:
                return f"{n:.1f} {unit}"
            n /= 1024
        return f"{n:.1f} TB"

    assert [x for (x,) in column(spark, [str(v) for v in values], a=names.format_size(F.col("v").cast("long")))] == [size(v) for v in values]


def test_packing_is_next_fit(spark):
    rng = random.Random(5)
    sizes = [rng.choice([1, 2, 3, 5, 9, 40]) for _ in range(400)]
    rows = spark.createDataFrame([(f"s{i:04d}", n) for i, n in enumerate(sizes)], "stem string, n long")
    want, batch, fill = [], 0, 0
    for n in sizes:
        if n > 12:
            batch, fill = batch + 1, 0
            want.append(batch)
            continue
        if fill == 0 or fill + n > 12:
            batch, fill = batch + 1, 0
        fill += n
        want.append(batch)
    for per in (20_000, 37):
        got = [r.batch_no for r in batches.pack(rows, 10, 2, per).orderBy("stem").collect()]
        assert got == want


def test_parts(spark):
    text = "# T\n\n" + "".join(f"## pcp_{k:03d}\n\nbody {k}\n" for k in range(5))
    rows = spark.createDataFrame([("s", "s.md", text), ("e", "e.md", "nothing here")], "stem string, src_name string, text string")
    got = {r.file_name: r.text for r in parts.split(rows, 2, "stem").collect()}
    assert set(got) == {"s__part01_pcp000-001.md", "s__part02_pcp002-003.md", "s__part03_pcp004-004.md", "e.md"}
    assert got["s__part03_pcp004-004.md"] == "# T\n\n_(part 3 / 3 : pcp_004 〜 pcp_004, 1 pcps, source: s.md)_\n\n## pcp_004\n\nbody 4\n"
    assert got["e.md"] == "nothing here"


def test_segments(spark):
    rows = spark.createDataFrame([(list("abcdef"), [1, 4]), ([], []), (["x"], [0]), (list("ab"), [])], "a array<string>, p array<int>")
    got = rows.select(pytext.segmented(F.col("a"), F.col("p"), lambda x, i, k: F.concat(x, i.cast("string"), k.cast("string"))).alias("x")).collect()
    assert [r.x for r in got] == [["a00", "b10", "c21", "d31", "e41", "f52"], [], ["x00"], ["a00", "b10"]]
    blocks = F.transform("p", lambda p: F.struct(p.alias("a"), F.least(p + 1, F.size("a") - 1).alias("b")))
    assert [r.x for r in rows.select(pytext.without(F.col("a"), blocks).alias("x")).collect()] == [["a", "d"], [], [], ["a", "b"]]


def test_platforms(spark, tmp_path):
    from threadloom import platforms

    (tmp_path / "a.json").write_text('[{"uuid": "c1", "name": "T", "chat_messages": [{"sender": "human", "text": "q"}]}]')
    assert [r.uuid for r in platforms.claude.parse_folder(spark, str(tmp_path)).collect()] == ["c1"]
    with pytest.raises(KeyError):
        platforms.of("nowhere")


def test_a_shared_folder_is_needed_on_a_cluster():
    from threadloom.plans import tables

    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session)
