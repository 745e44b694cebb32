"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text. A small classifier turns what surrounds a
block (elements, class and id words, share of link text, length) into a cost
for calling it content or boilerplate; neighbours on the page are tied by a cost
for labels that differ, the more the fewer elements open or close between them.
The minimum cut is the cheapest labelling: a short line inside an article stays, a
long advert between menus goes.

Only real structure (navigation, footers, forms, hidden elements) settles a block
by itself. Words of classes and ids weigh as much as what the text itself says, and
less where they may well be a heading's name: in ids, beside words for content, on
headings. Where a page marks its article, what lies outside has that against it.

Null html counts as empty; a page without content has an empty text. Rows
without an id and repeated rows give a row each; an empty table gives none.
Pages of any length are read whole; columns other than those named are not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.mincut import label

MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements whose text is never shown as text.
RAW = frozenset(["script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "noembed", "noframes", "xmp"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
INLINE = frozenset([
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "meter", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
])
# An opening tag ends an open element of the same row.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
CONTAINERS = frozenset(["ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "nav", "aside", "form", "footer", "header", "blockquote"])

# Weights of the classifier, in units of cost. Real structure outweighs any text statistic, names do not.
AWAY, TOWARDS = 12.0, 0.1
NAMED, MAYBE_NAMED, OUTSIDE = 5.0, 0.3, 3.0
TAG_WEIGHT = {"nav": -AWAY, "footer": -AWAY, "aside": -AWAY, "form": -AWAY, "button": -AWAY, "select": -AWAY, "menu": -AWAY, "dialog": -AWAY, "head": -AWAY, "article": TOWARDS, "main": TOWARDS}
ROLE_WEIGHT = {"main": TOWARDS, "article": TOWARDS} | dict.fromkeys(["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"], -AWAY)
BOILERPLATE = frozenset([
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "copyright", "disclaimer", "discussion", "disqus", "feedback", "foot", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "pager", "pagination", "paywall", "popup", "privacy", "promo", "promoted", "promotion", "rail",
    "recommended", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "taboola", "toolbar", "topbar", "widget",
])
CONTENT = frozenset(["article", "body", "content", "entry", "main", "post", "story", "text"])
HEADING_WORDS = frozenset(["header", "head"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
# What differing labels of neighbours cost: next to each other under one parent, and at most, per step between them.
TIED, STEP = 1.2, 2.0


def _named(value: str, is_id: bool, is_heading: bool) -> float:
    """What the words of a class or id say against content, or for it."""
    cost = 0.0
    for name in value.split():
        words = {w.lower() for w in WORD.findall(name)}
        bad, good = words & BOILERPLATE, words & CONTENT
        if good and bad <= HEADING_WORDS:
            cost = max(cost, TOWARDS / 2) if cost >= 0 else cost
        elif bad:
            maybe = good or is_heading or (is_id and words != bad)
            cost = min(cost, -MAYBE_NAMED if maybe else -NAMED)
    return cost


@functools.lru_cache(maxsize=4096)
def _weight(tag: str, attributes: str) -> tuple[float, float, float]:
    """What an element adds for content, against it by structure, and against it by name."""
    base = TAG_WEIGHT.get(tag, 0.0)
    up, down, named = max(base, 0.0), min(base, 0.0), 0.0
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name == "role":
                role = ROLE_WEIGHT.get(value.strip().lower(), 0.0)
                up, down = max(up, role), min(down, role)
            elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                down = -AWAY
            elif name == "itemprop":
                if value.strip().lower() == "articlebody":
                    up = max(up, TOWARDS)
            elif name in ("class", "id") and tag not in ("html", "body"):
                cost = _named(value, name == "id", tag in HEADINGS)
                up, named = max(up, cost), min(named, cost)
    if tag == "header" and down == 0.0 and named == 0.0:
        named = -NAMED  # a page's header goes, that of an article stays
    return up, down, named


class _Blocks:
    """The blocks of a page, in order."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.facts: list[tuple[float, float, float, str]] = []  # for, against, link share, tag
        self.steps: list[int] = []  # block elements that open or close before each block
        self.between = 0
        self.stack: list[tuple[str, float, float, float]] = [("", 0.0, 0.0, 0.0)]
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            self.parts = []
            if text:
                tag = next((x[0] for x in reversed(self.stack) if x[0] not in INLINE), "")
                _, up, down, named = self.stack[-1]
                self.texts.append(text)
                self.facts.append((up, down + named, min(1.0, self.linked / max(len(text), 1)), tag))
                self.steps.append(self.between)
                self.between = 0
        self.linked = 0

    def text(self, data: str) -> None:
        if data:
            self.parts.append(data)
            if self.open.get("a"):
                self.linked += len(data)

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
            self.between += tag in CONTAINERS
        elif tag == "br":
            self.parts.append(" ")
        if self.open.get(tag):
            while True:
                name = self.stack.pop()[0]
                self.open[name] -= 1
                if name == tag:
                    break

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
        else:
            self.flush()
            if self.open.get("p"):
                self.end("p")
            ends = ENDS.get(tag)
            if ends:
                for k in range(len(self.stack) - 1, 0, -1):
                    name = self.stack[k][0]
                    if name in ends:
                        self.end(name)
                        break
                    if name in CONTAINERS:
                        break
        if tag in VOID:
            return
        self.between += tag in CONTAINERS
        _, up, down, named = self.stack[-1]
        more, less, name = _weight(tag, attributes)
        if tag == "header" and up > 0 and name == -NAMED:
            name = 0.0
        self.stack.append((tag, max(up, more), min(down, less), min(named, name)))
        self.open[tag] = self.open.get(tag, 0) + 1


def read_blocks(html: str) -> _Blocks:
    """Blocks of a page; comments, markup and text that is never shown are left out."""
    page = _Blocks()
    at = 0
    while True:
        m = MARKUP.search(html, at)
        if m is None:
            page.text(html[at:])
            break
        page.text(html[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            page.end(tag)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = _raw_end(tag).search(html, at)
                at = end.end() if end else len(html)
            continue
        page.start(tag, attributes.strip().rstrip("/"))
    page.flush()
    return page


@functools.cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


def score(text: str, up: float, down: float, linked: float, tag: str) -> float:
    """Cost of calling a block boilerplate less the cost of calling it content."""
    length = min(2.0, math.log1p(len(text)) / 3) - 1.2
    ended = 0.5 if text[-1] in ".!?…:;\"'”»" else -0.2
    heading = 0.8 if tag in ("h1", "h2", "h3") else 0.0
    item = -0.4 if tag in ("li", "td", "th") else 0.6 if tag in ("p", "pre", "blockquote") else 0.0
    return up + down + length + ended + heading + item - 2.5 * linked


def main_text(html: str) -> tuple[str, int, int]:
    """The content of a page, its blocks joined by newlines; the numbers of blocks and of kept blocks."""
    page = read_blocks(html)
    scores = block_scores(page)
    edges = [(i - 1, i, TIED / (1 + STEP * page.steps[i])) for i in range(1, len(scores))]
    kept = [t for t, x in zip(page.texts, label(scores, edges), strict=True) if x]
    return "\n".join(kept), len(scores), len(kept)


def block_scores(page: _Blocks) -> list[float]:
    """The score of every block; where some lie in what a page marks as its article, the others have that against them."""
    marked = any(up >= TOWARDS and down > -AWAY for up, down, _, _ in page.facts)
    return [score(t, up, down, linked, tag) - (OUTSIDE if marked and up < TOWARDS else 0.0) for t, (up, down, linked, tag) in zip(page.texts, page.facts, strict=True)]


EXTRACTED = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType()),
])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_kept`` per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [main_text(x.as_py() or "") for x in batch.column("html")]
                texts = [x[0] for x in found]
                counts = ([len(t) for t in texts], [x[1] for x in found], [x[2] for x in found])
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=EXTRACTED.names)

    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return named.mapInArrow(run, EXTRACTED)
