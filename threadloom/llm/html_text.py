"""Operator 4: the main text of web pages.

The standard library's parser streams events. Text between block elements is a line, with the number of tags in it
and the share of its text inside links. Its ratio is its text by its tags; it is next to nothing where most of the text is
linked (headlines aside), and 0 where the elements around are what the markup itself, a role or a usual class name calls a menu, header, footer,
sidebar, notice, advert, form or comments. The ratios are smoothed with a Gaussian, and lines at or above a threshold, a share
of the smoothed ratios' standard deviation, form the content clusters; those of their lines whose own ratio reaches it too are
their cores. They select the regions: every article or main part with a core, unless the cores outside have more than SHARE_OUT of
their text; else the innermost container that holds all cores. All of a region's lines with a ratio stay, however
short (without a marked part, not those that are mostly links); so do cores in a cluster that reaches into a region, and what leads from a headline to it. No clusters, no text.

A class name counts as a whole: `cookieBanner` and `ad-box` name what they are, `has-sidebar`, `post-header` and
`search-algorithms` don't. A header, form or named element that holds a main headline or article and most of the
page's text is the page's frame and sets nothing apart; nor does the header of an article.

Cases: null and empty pages give an empty text; unclosed elements end where HTML ends them or with the element
around them; repeated rows and null ids are rows like any other; texts of any length are read whole; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean

SIGMA = 1.0
#: The threshold as a share of the smoothed ratios' standard deviation.
SHARE = 0.5
#: Dense text beside the articles that is content too, as a share of theirs.
SHARE_OUT = 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul noscript template".split())
#: What no reader sees as text of the page, what is never content, and what isn't unless it is the page's frame.
_UNSEEN = frozenset("head title script style noscript template iframe object svg canvas audio video map".split())
_NEVER = frozenset("nav menu footer aside button select textarea dialog".split())
_SELDOM = frozenset("header form fieldset label".split())
_CLOSES = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body", "article", "main", "nav", "header", "div", "p", "section"}}
_BOUNDARY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: Class names' words for what is never content, and for what isn't unless it is the page's frame.
_NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr comment comments commentlist disqus respond reply replies "
    "breadcrumb breadcrumbs crumbs footer foot colophon copyright nav navbar navigation menu menus pagination pager share sharing social related recommended recommendations outbrain taboola newsletter subscribe subscription signup".split()
)
_SELDOM_WORDS = frozenset("banner notice notices alert alerts sidebar sidebars side rail aside header masthead topbar discussion popup modal overlay login search searchbox toolbar widget widgets skip tags tagcloud paywall form disclaimer".split())
_PLAIN_WORDS = frozenset("box wrapper wrap container area list block item items section bar left right top bottom main site page global primary secondary inner outer slot unit button buttons link links body text content user reader readers new js row col column group panel thread posts articles stories form field fields message policy note info".split())
#: What may be the region of a page without an article: paragraphs, headings, lists and the like lie beside others of its text.
_CONTAINERS = frozenset("article body center div html main section td".split())
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_ROLES_NEVER = frozenset("navigation contentinfo complementary alert dialog menu menubar toolbar".split())
_ROLES_SELDOM = frozenset("banner search form".split())
_MAIN = re.compile(r"articlebody|mainentityofpage", re.I)
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How an element sets its text apart: not, unless it is the page's frame, always, or so that it isn't even a line.
_IN, _FRAME, _OUT, _GONE = range(4)
#: The ratio of a line that is mostly links.
_LINKED = 1e-9


class Line:
    __slots__ = ("text", "tags", "linked", "path", "article", "kind", "apart")

    def __init__(self, text: str, tags: int, linked: int, path: tuple, article: int, kind: str, apart: tuple | None):
        #: apart: None where the text is never content, else the elements that set it apart unless they are the page's frame
        self.text, self.tags, self.linked, self.path, self.article, self.kind, self.apart = text, tags, linked, path, article, kind, apart


class Reader(HTMLParser):
    """Lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        #: (tag, number, how it sets apart, number of the article around or 0, the elements with _FRAME around)
        self.open: list[tuple[str, int, int, int, tuple]] = []
        self.count = self.tags = self.links = self.linked = 0
        self.parts: list[str] = []
        #: Elements with _FRAME that hold a main headline or an article.
        self.framing: set[int] = set()

    def line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tag, _, apart, article, frames = self.open[-1] if self.open else ("", 0, _IN, 0, ())
                path = tuple(x[1] for x in self.open if x[0] in _CONTAINERS)
                kind = next((x[0] for x in reversed(self.open) if x[0] in _HEADS), tag)
                self.lines.append(Line(text, self.tags, self.linked, path, article, kind, None if apart >= _OUT else frames))
        self.parts, self.tags, self.linked = [], 0, 0

    def apart(self, tag: str, attrs: list, up: tuple) -> int:
        if tag in _UNSEEN:
            return _GONE
        if tag in ("html", "body"):
            return _IN
        at = dict(attrs)
        if "hidden" in at or (at.get("aria-hidden") or "").lower() == "true" or "display:none" in (at.get("style") or "").replace(" ", "").lower():
            return _GONE
        role, named = (at.get("role") or "").lower(), _IN if tag in _HEADS else _named(at)
        if tag in _NEVER or role in _ROLES_NEVER or named == _OUT:
            return _OUT
        if tag in ("article", "main"):
            return _IN
        if tag == "header" and up[3]:
            return _IN
        return _FRAME if tag in _SELDOM or role in _ROLES_SELDOM or named else _IN

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self.line()
        elif tag in ("br", "hr", "wbr"):
            self.parts.append(" " if tag != "wbr" else "")
        self.tags += 1
        if tag == "a":
            self.links += 1
        for name, closers in _CLOSES.items():
            if tag in closers:
                self.close_to(name, _BOUNDARY.get(name, {"article", "main", "section", "div", "td", "body", "blockquote", "li"} if name == "p" else ()))
        if tag in _VOID or (tag not in _BLOCK and tag not in _UNSEEN and tag not in _NEVER and tag not in _SELDOM and tag != "span"):
            return
        up = self.open[-1] if self.open else ("", 0, _IN, 0, ())
        how = self.apart(tag, attrs, up)
        if how and tag not in _BLOCK:
            how = _GONE
        self.count += 1
        marked = tag in ("article", "main") or any(k == "role" and v == "main" or k == "itemprop" and v and _MAIN.search(v) for k, v in attrs)
        # a menu left open doesn't hold the article
        around = max(up[2], how)
        if marked and how < _OUT and up[2] == _OUT and not any(x[2] >= _OUT and x[0] not in ("nav", "menu") for x in self.open):
            around = how
        article = up[3] or (self.count if marked and around < _OUT else 0)
        if around < _OUT and (marked or tag == "h1"):
            self.framing.update(up[4])
        self.open.append((tag, self.count, around, article, up[4] + (self.count,) if how == _FRAME else up[4]))

    def close_to(self, tag: str, stop) -> None:
        """End an open element of this name, unless one of `stop` lies inside it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.line()
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in _BLOCK:
            self.line()
        self.tags += 1
        if tag in _BLOCK or tag in _UNSEEN or tag in _NEVER or tag in _SELDOM or tag == "span":
            stop = ("article", "main", "body") if tag in ("span", "p", "div", "li", "section") else ()
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    del self.open[i:]
                    return
                if self.open[i][0] in stop:
                    return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2] == _GONE:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def _named(at: dict) -> int:
    """How the element's class names and id set it apart; only names that say nothing else count."""
    found = _IN
    for name in f"{at.get('class') or ''} {at.get('id') or ''}".split():
        words = {w.lower() for w in _SPLIT.split(name) if w}
        if words and words <= _NEVER_WORDS | _SELDOM_WORDS | _PLAIN_WORDS:
            if words & _NEVER_WORDS:
                return _OUT
            if words & _SELDOM_WORDS:
                found = _FRAME
    return found


def ratios(lines: list[Line], framing: set[int]) -> list[float]:
    """Text by tags of each line; next to nothing where most of it is linked, and 0 where it is set apart."""
    held: Counter = Counter()
    for x in lines:
        for n in x.apart or ():
            held[n] += len(x.text) - x.linked
    total = sum(len(x.text) - x.linked for x in lines if x.apart is not None)
    frames = {n for n in held if n in framing and 2 * held[n] > total}
    return [0.0 if x.apart is None or not frames.issuperset(x.apart) else _LINKED if linked(x) else len(x.text) / max(1, x.tags) for x in lines]


def linked(x: Line) -> bool:
    """Whether most of a line other than a headline is inside links."""
    return x.linked * 2 > len(x.text) and x.kind not in ("h1", "h2")


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """A Gaussian mean over each line and its neighbours."""
    reach = math.ceil(sigma) * 2
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        a, b = max(0, i - reach), min(len(ratios), i + reach + 1)
        w = kernel[a - i + reach : b - i + reach]
        out.append(sum(x * y for x, y in zip(ratios[a:b], w)) / sum(w))
    return out


def content(lines: list[Line], framing: set[int] = frozenset()) -> list[Line]:
    """The lines of the content regions."""
    if not lines:
        return []
    ratio = ratios(lines, framing)
    mean = smoothed(ratio)
    middle = sum(mean) / len(mean)
    spread = math.sqrt(sum((x - middle) ** 2 for x in mean) / len(mean))
    least = SHARE * spread
    dense = [m >= least and m > 0 and r > 0 for m, r in zip(mean, ratio)]
    core = [d and r >= least for d, r in zip(dense, ratio)]
    if not any(core):
        return [x for x, d in zip(lines, dense) if d]
    size: Counter = Counter()
    for x, c in zip(lines, core):
        if c:
            size[x.article] += len(x.text)
    articles = set(size) - {0}
    if articles and size[0] <= SHARE_OUT * sum(size[a] for a in articles):
        kept = [x.article in articles for x in lines]
        for step in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
            for i in step:
                kept[i] |= core[i] and kept[i - step.step]
    else:
        inside = set.intersection(*(set(x.path) for x, c in zip(lines, core) if c))
        held = Counter(n for x in lines for n in x.path if n in inside)
        region = max((n for n in inside if held[n] > 1), default=None)
        kept = [(region is None or region in x.path) and not linked(x) for x in lines]
    if not any(kept):
        return []
    # back to a headline right before the region, or without an article to a lead
    first = kept.index(True)
    back = first
    while back and ratio[back - 1] > 0 and not linked(lines[back - 1]) and (lines[back - 1].kind in _HEADS or lines[back - 1].kind == "p"):
        back -= 1
    heads = [i for i in range(back, first) if lines[i].kind in ("h1", "h2")]
    if heads:
        back = heads[0]
    elif articles:
        back = first
    for i in range(back, first):
        kept[i] = True
    return [x for x, k, r in zip(lines, kept, ratio) if k and r > 0]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.line()
    return "\n".join(x.text for x in content(reader.lines, reader.framing))


def extracted(pages: DataFrame) -> DataFrame:
    """For pages(page_id, url, html): page_id, url, text and its number of code points."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [main_text(x) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
