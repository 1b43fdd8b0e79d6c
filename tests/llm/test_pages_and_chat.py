"""Operators 4 and 9: pages with known text, and round trips."""

import hashlib
import random

import pytest

from threadloom.llm import chat, html_text

PAGES = [
    ("<html><head><title>t</title></head><body><header>Site <a href=x>Home</a></header><nav><a>1</a></nav><div class='cookie-notice'>We use cookies</div><main><h1>Title</h1><p>Short.</p><p>Hello &amp; bye&nbsp;now <b>bold</b> end.<p>Two<div class='ad-box'>Buy</div><form><input>Name</form></main><aside>side</aside><section class='comments'><p>great post</p></section><footer>f</footer></body>", "Title\nShort.\nHello & bye now bold end.\nTwo"),
    ("<div id='menu'><a>a</a> <a>b</a></div><div id='content'><h1>Big story</h1><p>" + "word " * 50 + "</p><p>ok.</p><p>" + "more " * 40 + "</p></div><div class='sidebar'>x</div><div id='comments'><p>" + "troll " * 60 + "</p></div>", "Big story\n" + ("word " * 50).strip() + "\nok.\n" + ("more " * 40).strip()),
    (None, ""),
    ("", ""),
    ("<p>just", "just"),
    ("<script>var a='<p>x</p>'</script>plain   text", "plain text"),
    ("<article><header><h1>T</h1><p>by me</p></header><p>body</p><ul><li>one<li>two</ul><div class=comments><article class=comment>bad</article></div></article>", "T\nby me\nbody\none\ntwo"),
    ("<nav><ul><li><a>x</a></ul><article><p>text</p></article>", "text"),
    ("<article><p><b>One.<br><p>Two&#8212;2 &lt;b&gt;</p><style>p{}</style><!-- no --></article><footer>end", "One.\nTwo\u20142 <b>"),
    ("<article>" + "<p>long text here</p>" * 20_000 + "</article>", "\n".join(["long text here"] * 20_000)),
]


@pytest.mark.parametrize("html, text", PAGES, ids=range(len(PAGES)))
def test_main_text(html, text):
    assert html_text.main_text(html) == text


LONG = ("word " * 200).strip()
REGIONS = [
    (f"<div><h1>Title</h1><p>{LONG}</p><p>ok.</p></div>", f"Title\n{LONG}\nok."),
    (f"<body><h1>Title</h1><p>Lead</p><div class='text'><p>{LONG}</p><p>{LONG}</p></div></body>", f"Title\nLead\n{LONG}\n{LONG}"),
    (f"<div><h1>Title</h1><div>a</div><div>b</div><div>c</div><div>{LONG}</div></div>", f"Title\na\nb\nc\n{LONG}"),
    (f"<ul><li>{LONG}</li><li>two</li></ul><p>end</p>", f"{LONG}\ntwo\nend"),
    (f"<article><p>{LONG}</p></article><p>between</p><article><h2>Next</h2><p>{LONG} too</p></article>", f"{LONG}\nNext\n{LONG} too"),
    (f"<article><a href=x>only a link</a></article><div><h1>Title</h1><p>{LONG}</p></div>", f"Title\n{LONG}"),
    ("<article><a href=x>only a link</a></article><article><a href=y>another</a></article>", "only a link\nanother"),
    (f"<article><h1><a href=x>Title</a></h1><p>{LONG}</p><p><a href=y>More of it</a></p></article><p><a href=z>Next</a></p>", f"Title\n{LONG}\nMore of it"),
    (f"<p><a href=z>Home</a></p><div><h1><a href=x>Title</a></h1><p>{LONG}</p><p><a href=y>More</a></p><p>{LONG}</p></div>", f"Title\n{LONG}\n{LONG}"),
    (f"<div class='layout has-sidebar'><div class='post-header'><h1>Title</h1></div><section id='search-algorithms'><p>{LONG}</p></section><p class='tags-explained'>Tags.</p><div class='sidebar'>side</div></div>", f"Title\n{LONG}\nTags."),
    (f"<article><header><h1>Title</h1><p>Lead</p></header><p>{LONG}</p><footer>by me</footer></article>", f"Title\nLead\n{LONG}"),
    (f"<div class='cookieBanner'>We bake</div><h1>Title</h1><p>Lead</p><div><p>{LONG}</p><p>{LONG}</p></div>", f"Title\nLead\n{LONG}\n{LONG}"),
    (f"<p>Intro.</p><div><div><p>{LONG}</p></div><p>{LONG}</p></div>", f"Intro.\n{LONG}\n{LONG}"),
    (f"<div class='header'><h1>Title</h1><p>{LONG}</p></div><p>after</p>", f"Title\n{LONG}"),
    (f"<div class='site-header'><b>Site</b> slogan</div><h1>Title</h1><article><p>{LONG}</p></article><div class='user-comments'><article><p>{LONG}</p></article></div>", f"Title\n{LONG}"),
    (f"<form id=f><article><p>{LONG}</p></article></form><form>Name</form>", LONG),
    (f"<div><a href=1>one</a> <a href=2>two</a></div><p>{LONG}</p><button>Go</button><p>x <span class=ad>buy</span> y</p>", f"{LONG}\nx y"),
    ("<nav>one</nav><footer>two words</footer>", ""),
    ("<div><a href=x>one</a></div><div><a href=y>two</a></div>", ""),
]


@pytest.mark.parametrize("html, text", REGIONS, ids=range(len(REGIONS)))
def test_regions(html, text):
    assert html_text.main_text(html) == text


def test_pages(spark):
    rows = [(i, None if i % 2 else "u", h, "clash") for i, (h, _) in enumerate(PAGES)] + [(None, "u", PAGES[4][0], "x"), (0, "u", PAGES[0][0], "x")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [(i, u, html_text.main_text(h)) for i, u, h, _ in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ratios_decide(monkeypatch):
    """Flat ratios change pages with and without an article, and without clusters there is no text."""
    pages = [h for h, t in [*PAGES, *REGIONS] if t and "<nav" in h or h and "sidebar" in h]
    plain = f"<div>Home of all words</div><div>A slogan</div><p><a href=x>More</a></p><div><p>{LONG}</p><p>{LONG}</p></div><div>All rights</div>"
    assert html_text.main_text(plain) == f"{LONG}\n{LONG}"
    before = [html_text.main_text(h) for h in pages]
    with monkeypatch.context() as m:
        m.setattr(html_text, "ratios", lambda lines, framing: [1.0] * len(lines))
        assert all(html_text.main_text(h) != t for h, t in zip(pages, before)) and len(pages) > 3
    with monkeypatch.context() as m:
        m.setattr(html_text, "smoothed", lambda ratios: [1.0] * len(ratios))
        assert html_text.main_text(plain) != f"{LONG}\n{LONG}"
        m.setattr(html_text, "smoothed", lambda ratios: [0.0] * len(ratios))
        assert not any(html_text.main_text(h) for h in [*pages, plain])


def test_smoothing_keeps_the_mean_of_a_plain():
    assert html_text.smoothed([3.0] * 5) == pytest.approx([3.0] * 5)
    assert max(html_text.smoothed([0, 0, 9, 0, 0])) < 9


def test_pages_of_any_tags():
    """No page crashes, and every line of text is a line of the page's visible text."""
    rng = random.Random(8)
    bits = ["<div>", "</div>", "<p>", "</p>", "<article>", "</article>", "<nav>", "</nav>", "<h1>", "</h1>", "<a href=x>", "</a>", "word ", "more of it ", "<header>", "</header>", "<form>", "</form>", "<li>", "<ul>", "</ul>", "<br>", "<div class=ad>", "<section class=comments>", "</section>", "<span class=ad>", "</span>", "<button>", "</button>", "<td>", "<tr>", "<!-- x -->", "&amp;", "<script>x</script>"]
    for _ in range(5000):
        page = "".join(rng.choices(bits, k=rng.randint(1, 25)))
        text = html_text.main_text(page)
        assert text == "\n".join(" ".join(x.split()) for x in text.split("\n")) and ("\n\n" not in text) and "<" not in text, page


ROLES = ["user", "assistant", "system", None, "tool", 'a"] [/TURN] ', '[TURN "x"]', "x\\"]
BITS = ["\\", "[INST]", "[/INST] ", "</s>", "<s>", " ", "[ANS] ", "[TURN ", "a", "\n", "[/TURN]", '"] ', "[", "]", "<", " </s>", " [/SYS]"]


def test_round_trip():
    rng = random.Random(2)
    for _ in range(20_000):
        turns = [(rng.choice(ROLES), "".join(rng.choices(BITS, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 4))]
        text = chat.BEGIN + "".join(chat.render(r, t)[0] for r, t in turns)
        assert chat.read_all(text) == [(r or "", t) for r, t in turns]


def conversations():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(ROLES[:5]), "".join(rng.choices(BITS, k=5))) for c in range(40) for t in range(rng.randint(1, 7))]
    return rows + [(None, 0, "user", "q"), (None, 1, "assistant", None), (50, None, "user", None), (50, 2, "assistant", "a"), (51, 0, "user", "same"), (51, 0, "user", "same"), (51, 1, "assistant", "x" * 100_000)]


def by_conversation(rows):
    out = {}
    for r in sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in (r[0], r[1], r[2])) + (r[3] or "",)):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def test_digests(spark):
    rows = conversations()
    t = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example long")
    got = {r.conv_id: r for r in chat.digests(t).collect()}
    made: dict = {}
    for e in chat.examples(t).collect():
        made.setdefault(e.conv_id, []).append(e)
    want = by_conversation(rows)
    assert set(got) == set(want) == set(made)
    for c, turns in want.items():
        r, examples = got[c], sorted(made[c], key=lambda e: e.example)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        reply = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(reply), hashlib.sha256(reply.encode()).hexdigest())
        assert "".join(chat.unescape(e.text[e.loss_start : e.loss_end]) for e in examples) == reply
        assert chat.read_all(examples[-1].text) == turns
        assert all(examples[-1].text.startswith(e.text) for e in examples)
        assert r.formatted_chars == sum(len(e.text) for e in examples)
    assert chat.digests(t.limit(0)).count() == 0 and chat.examples(t.limit(0)).count() == 0
