"""Operator 11: the main text of pages, from flat text blocks and a decision tree.

A page is read once, as a row of text blocks: runs of text between tags that aren't inline. A block has few numbers: its words,
the share of them inside links, the same of the blocks before and behind it, and what kind of container holds it. A tree that
is grown on a small labelled table tells the article's blocks from all others. Pages are independent: no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag with its attributes (quotes count only behind an equals sign, as HTML has it), a comment, or other markup. What the end of
#: the page cuts off is a tag too. Nothing here can be matched in two ways, so time is linear.
_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+|=)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^\s>"'][^\s>]*+)))?+|=""")

# Fixed values of HTML: elements without content, inline elements, raw text, and those whose content is no text of the page.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(
    ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "meter", "nobr", "output")
    + ("q", "rb", "rp", "rt", "ruby", "s", "samp", "select", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "wbr")
)
RAW = frozenset(("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"))
HIDDEN = frozenset(("head", "template", "svg", "object", "select", "datalist", "button", "canvas", "audio", "video", "noscript", "map", "applet"))
IN_HEAD = frozenset(("base", "link", "meta", "noscript", "script", "style", "template", "title"))
#: Elements whose start closes an open one of the same row's kind: (the elements, what shields an outer one).
SAME = (
    (frozenset(("p",)), frozenset(("td", "th", "table", "caption", "object", "template"))),
    (frozenset(("li",)), frozenset(("ul", "ol", "menu", "table"))),
    (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    (frozenset(("td", "th")), frozenset(("table",))),
    (frozenset(("tr",)), frozenset(("table",))),
    (frozenset(("option",)), frozenset(("select",))),
)
_KIND = {name: k for k, (own, _) in enumerate(SAME) for name in own}
_SHIELDS = {name: tuple(k for k, (_, by) in enumerate(SAME) if name in by) for name in {x for _, by in SAME for x in by}}

# What containers are: of the page around the article, or of the article.
AROUND_TAGS = frozenset(("nav", "footer", "aside", "form", "dialog", "menu", "fieldset", "search"))
AROUND_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist", "status"))
ARTICLE_ROLES = frozenset(("article", "main"))
#: Words of class and id attributes.
AROUND_WORDS = frozenset(
    ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "promoted", "nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs")
    + ("sidebar", "aside", "rail", "widget", "widgets", "footer", "foot", "header", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay")
    + ("newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "pagination", "pager", "copyright", "legal", "disclaimer", "skip")
)
COMMENT_WORDS = frozenset(("comment", "comments", "commentlist", "disqus", "replies", "reply", "responses", "respond", "discussion", "reactions"))
ARTICLE_WORDS = frozenset(("article", "post", "entry", "story", "content", "main", "body", "articlebody", "maincontent", "prose"))
#: What an inline element needs in order to matter.
_MAY_HIDE = re.compile(r"(?i)hid|display|role|itemprop")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: Kinds of containers. What is hidden or in comments stays so, whatever is inside.
UNSEEN, COMMENTS, AROUND, NEUTRAL, ARTICLE = -3, -2, -1, 0, 1
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _container(name: str, attributes: str, outer: int) -> int:
    """The kind of an element's inside, given what it is in."""
    if outer <= COMMENTS:
        return outer
    if name in HIDDEN:
        return UNSEEN
    if name in INLINE and not _MAY_HIDE.search(attributes):
        return outer
    return _of_attributes(name, attributes.strip(), outer)


@lru_cache(4096)
def _of_attributes(name: str, attributes: str, outer: int) -> int:
    found: dict[str, str] = {}
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            if m[1]:
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    words: set[str] = set()
    for x in (found.get("class", ""), found.get("id", "")):
        for one in x.split():
            parts = [w.lower() for w in _NAMES.findall(one)]
            if parts and parts[0] not in ("has", "with", "no", "without", "is") and "with" not in parts:
                words.update(parts)
    role = found.get("role", "").strip().lower()
    page = name in ("html", "body")  # their classes tell what the page has, not what they are
    if not page and words & COMMENT_WORDS and name not in ("a", "span"):
        return COMMENTS
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    if hidden and not page:
        return UNSEEN
    if name in ("article", "main") or role in ARTICLE_ROLES or found.get("itemprop", "").lower() == "articlebody":
        # A teaser in a list beside the article is no article.
        return ARTICLE if outer >= NEUTRAL or name == "main" or role == "main" or not words & AROUND_WORDS else outer
    if name in AROUND_TAGS or role in AROUND_ROLES or (name == "header" and outer != ARTICLE):
        return AROUND
    if name in INLINE or page or name in _HEADINGS:
        return outer
    if outer == ARTICLE and name == "header":
        return outer
    around = words & AROUND_WORDS
    if around == {"header"} and (outer == ARTICLE or words & {"article", "post", "entry", "story"}):
        around = set()
    if around:
        return AROUND
    return ARTICLE if words & ARTICLE_WORDS and outer == NEUTRAL else outer


class Blocks:
    """A page's text blocks: texts, words, words inside links, kinds of containers, and whether they are headings."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.rows: list[tuple[int, int, int, int]] = []
        self.run: list[str] = []
        self.linked = self.links = 0
        #: Open elements: name, kind of container, and for each kind of SAME the place of the open one that a new one closes.
        none = (-1,) * len(SAME)
        self.open: list[tuple[str, int, tuple[int, ...]]] = [("", NEUTRAL, none)]
        self.names: dict[str, list[int]] = {}
        self.heading = 0
        #: Places of the open elements that aren't inline.
        self.blocks: list[int] = []
        at, search = 0, _TAG.search
        while m := search(page, at):
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if name == "br":
                self.text(" ")
                continue
            if name not in INLINE:
                self.end_block()
            if m[1]:
                self.close(name)
            elif name in RAW:
                at = self.raw_end(page, name, at)
            else:
                self.start(name, m[3])
        if at < len(page):
            self.text(page[at:])
        self.end_block()

    @staticmethod
    def raw_end(page: str, name: str, at: int) -> int:
        """Where raw text ends: at its own end tag, or with the page."""
        m = _raw_end(name).search(page, at)
        return m.end() if m else len(page)

    def text(self, raw: str) -> None:
        if self.open[-1][1] == UNSEEN:
            return
        part = html.unescape(raw) if "&" in raw else raw
        self.run.append(part)
        if self.links:
            self.linked += len(part.split())

    def end_block(self) -> None:
        if not self.run:
            return
        words = "".join(self.run).split()
        if words:
            self.texts.append(" ".join(words))
            self.rows.append((len(words), min(self.linked, len(words)), self.open[-1][1], self.heading > 0))
        self.run, self.linked = [], 0

    def start(self, name: str, attributes: str) -> None:
        if name not in IN_HEAD and self.names.get("head"):
            self.close("head")
        kind = _KIND.get(name)
        inline = name in INLINE
        if kind is not None and (own := self.open[-1][2][kind]) >= 0 or not inline and (own := self.open[-1][2][0]) >= 0:
            self.cut(own)  # the open one of its kind, or the paragraph that a block ends
        if name == "a" and self.names.get("a"):
            self.close("a")
        if name in VOID:
            return
        place, outer = len(self.open), self.open[-1]
        last = outer[2]
        if kind is not None:
            last = last[:kind] + (place,) + last[kind + 1 :]
        for k in _SHIELDS.get(name, ()):
            last = last[:k] + (-1,) + last[k + 1 :]
        self.links += name == "a"
        self.heading += name in _HEADINGS
        self.open.append((name, _container(name, attributes, outer[1]), last))
        self.names.setdefault(name, []).append(place)
        if not inline:
            self.blocks.append(place)

    def close(self, name: str) -> None:
        places = self.names.get(name)
        if not places:
            return
        place = places[-1]
        if name in INLINE and self.blocks and self.blocks[-1] > place:
            # An inline element's end closes no block that was opened inside it: only its own effect ends.
            places.pop()
            self.links -= name == "a"
            self.open[place] = ("", *self.open[place][1:])
        else:
            self.cut(place)

    def cut(self, place: int) -> None:
        """Close the open elements from this place on."""
        while len(self.open) > place:
            name = self.open.pop()[0]
            if name:
                self.names[name].pop()
            self.links -= name == "a"
            self.heading -= name in _HEADINGS
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)


#: Columns of a block that the tree sees.
COLUMNS = ("words", "link density", "words before", "link density before", "words behind", "link density behind", "container", "heading", "container before", "container behind")
#: A number of words beyond which they tell nothing.
MOST_WORDS = 60


def features(pages: list[list[tuple[int, int, int, int]]]) -> np.ndarray:
    """The columns of all blocks of pages; before a page's first and behind its last are zeros and a container of the page."""
    sizes = np.array([len(p) for p in pages])
    a = np.array([row for p in pages for row in p], np.float64).reshape(-1, 4)
    page, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    kind = np.clip(a[:, 2], AROUND, ARTICLE)
    marked, bare = (np.bincount(page, a[:, 0] * (kind == k), len(sizes)) for k in (ARTICLE, NEUTRAL))
    kind[(kind == NEUTRAL) & (marked >= bare)[page] & (marked > 0)[page]] = AROUND  # beside what is marked as the article
    own = np.column_stack([np.minimum(a[:, 0], MOST_WORDS), a[:, 1] / np.maximum(a[:, 0], 1), kind])
    edge = np.array([0.0, 0.0, AROUND])
    before, behind = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[(ends - sizes)[sizes > 0]], behind[ends[sizes > 0] - 1] = edge, edge
    return np.column_stack([own[:, :2], before[:, :2], behind[:, :2], own[:, 2], a[:, 3], before[:, 2], behind[:, 2]])


# A small labelled table: fixed values, chosen by hand. For each page its blocks in order, as (kind of container, heading, words, words in
# links, is it the article's).
_A, _N, _P = ARTICLE, NEUTRAL, AROUND
LABELLED = (
    # An article element between menus, a notice and a footer.
    ((_P, 0, 1, 1, 0), (_P, 0, 1, 1, 0), (_P, 0, 9, 0, 0), (_A, 1, 8, 0, 1), (_A, 0, 60, 0, 1), (_A, 0, 31, 2, 1), (_A, 0, 4, 0, 1), (_A, 0, 1, 0, 1), (_P, 0, 12, 0, 0)),
    ((_P, 0, 24, 2, 0), (_A, 1, 5, 0, 1), (_A, 0, 1, 0, 1), (_P, 0, 7, 0, 0)),
    ((_P, 0, 2, 2, 0), (_A, 0, 3, 0, 1), (_A, 0, 22, 0, 1), (_P, 0, 40, 0, 0), (_A, 0, 18, 5, 1), (_A, 0, 2, 0, 1)),
    # An article with a quoted title that links, a lone link, and one that is all links at its end.
    ((_P, 0, 1, 1, 0), (_A, 1, 6, 6, 1), (_A, 0, 45, 3, 1), (_A, 0, 5, 5, 1), (_A, 0, 38, 0, 1), (_A, 1, 2, 0, 1), (_A, 0, 27, 1, 1), (_A, 0, 3, 3, 0), (_A, 0, 4, 4, 0), (_A, 0, 2, 2, 0), (_P, 0, 30, 4, 0)),
    ((_A, 1, 7, 0, 1), (_A, 0, 2, 2, 0), (_A, 0, 1, 1, 0), (_A, 0, 2, 2, 0), (_A, 0, 50, 0, 1), (_A, 0, 14, 1, 1), (_A, 0, 9, 0, 1), (_P, 0, 55, 0, 0), (_P, 0, 60, 0, 0)),
    # Lists, tables and short lines in an article.
    ((_P, 0, 3, 3, 0), (_A, 1, 4, 0, 1), (_A, 0, 12, 0, 1), (_A, 0, 2, 0, 1), (_A, 0, 1, 0, 1), (_A, 0, 3, 0, 1), (_A, 0, 2, 0, 1), (_A, 0, 6, 3, 1), (_A, 0, 60, 9, 1), (_P, 0, 5, 5, 0)),
    # Pages whose containers say nothing: menus first, a footer last.
    ((_N, 0, 1, 1, 0), (_N, 0, 2, 2, 0), (_N, 0, 1, 1, 0), (_N, 1, 9, 0, 1), (_N, 0, 42, 1, 1), (_N, 0, 60, 0, 1), (_N, 0, 33, 2, 1), (_N, 0, 5, 0, 1), (_N, 0, 28, 0, 1), (_N, 0, 3, 3, 0), (_N, 0, 2, 2, 0), (_N, 0, 6, 0, 0)),
    ((_N, 0, 2, 2, 0), (_N, 0, 3, 3, 0), (_N, 0, 16, 4, 0), (_N, 1, 6, 0, 1), (_N, 0, 25, 0, 1), (_N, 0, 3, 0, 1), (_N, 0, 48, 0, 1), (_N, 1, 3, 0, 1), (_N, 0, 37, 4, 1), (_N, 0, 8, 6, 0), (_N, 0, 5, 1, 0)),
    ((_N, 0, 1, 1, 0), (_N, 0, 1, 1, 0), (_N, 0, 60, 0, 1), (_N, 0, 54, 0, 1), (_N, 0, 20, 1, 1), (_N, 0, 4, 4, 0), (_N, 0, 7, 0, 0)),
    ((_N, 0, 4, 4, 0), (_N, 1, 11, 0, 1), (_N, 0, 60, 3, 1), (_N, 0, 60, 0, 1), (_N, 0, 9, 0, 1), (_N, 0, 44, 0, 1), (_N, 0, 10, 9, 0), (_N, 0, 12, 12, 0), (_N, 0, 4, 0, 0), (_N, 0, 3, 3, 0)),
    ((_N, 0, 5, 0, 0), (_N, 0, 1, 1, 0), (_N, 0, 2, 2, 0), (_N, 0, 36, 0, 1), (_N, 0, 2, 0, 1), (_N, 0, 29, 2, 1), (_N, 0, 60, 6, 1), (_N, 0, 1, 1, 0), (_N, 0, 1, 1, 0), (_N, 0, 8, 2, 0)),
    # Nothing but a list of links, and a bare text.
    ((_N, 0, 4, 4, 0), (_N, 0, 6, 6, 0), (_N, 0, 5, 5, 0), (_N, 0, 7, 6, 0), (_N, 0, 3, 0, 0)),
    ((_N, 0, 52, 0, 1), (_N, 0, 19, 0, 1), (_N, 0, 60, 1, 1)),
    ((_N, 0, 23, 0, 1),),
    # An article that ends with its page, or is cut off.
    ((_P, 0, 2, 2, 0), (_A, 1, 5, 0, 1), (_A, 0, 40, 0, 1), (_A, 0, 6, 0, 1)),
    ((_A, 0, 9, 0, 1),),
    ((_A, 1, 3, 0, 1), (_A, 0, 4, 1, 1)),
    # Prose with a line about the site below it.
    ((_P, 0, 1, 1, 0), (_N, 1, 4, 0, 1), (_N, 0, 57, 0, 1), (_N, 0, 1, 0, 1), (_N, 0, 60, 2, 1), (_N, 0, 3, 0, 0)),
    ((_N, 0, 2, 2, 0), (_N, 1, 6, 0, 1), (_N, 0, 31, 0, 1), (_N, 0, 40, 0, 1), (_N, 0, 6, 0, 0)),
    ((_N, 0, 60, 0, 1), (_N, 0, 46, 1, 1), (_N, 0, 9, 0, 0)),
    ((_N, 1, 8, 0, 1), (_N, 0, 60, 0, 1), (_N, 0, 5, 1, 0)),
    # Sidebars and comments beside an article of which only they are marked.
    ((_P, 0, 2, 2, 0), (_N, 1, 7, 0, 1), (_N, 0, 39, 0, 1), (_N, 0, 2, 0, 1), (_N, 0, 26, 1, 1), (_P, 0, 47, 0, 0), (_P, 0, 13, 0, 0), (_P, 0, 1, 0, 0)),
    ((_P, 0, 1, 1, 0), (_N, 1, 3, 0, 1), (_N, 0, 1, 0, 1), (_N, 0, 11, 0, 1), (_N, 0, 4, 0, 1), (_P, 0, 6, 0, 0)),
)


class Tree:
    """A decision tree of thresholds, grown by the least Gini impurity; ties go to the earlier column and smaller threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.share = float(y.mean())
        self.column = -1
        if depth == 0 or self.share in (0.0, 1.0):
            return
        best = len(y) * self.share * (1 - self.share) - 1e-9
        for c in range(x.shape[1]):
            order = np.argsort(x[:, c], kind="stable")
            value, ones, n = x[order, c], np.cumsum(y[order])[:-1], np.arange(1, len(y))
            total = float(y.sum())
            impurity = ones * (1 - ones / n) + (total - ones) * (1 - (total - ones) / (len(y) - n))
            impurity[value[1:] == value[:-1]] = np.inf
            if len(impurity) and impurity.min() < best - 1e-9:
                k = int(impurity.argmin())
                best, self.column, self.at = float(impurity[k]), c, float(value[k] + value[k + 1]) / 2
        if self.column >= 0:
            low = x[:, self.column] <= self.at
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Whether each row belongs to the article."""
        if self.column < 0 or not len(x):
            return np.full(len(x), self.share >= 0.5)
        low = x[:, self.column] <= self.at
        out = np.empty(len(x), bool)
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def labelled_table(pages=LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled pages' blocks."""
    x = features([[(words, linked, kind, heading) for kind, heading, words, linked, _ in page] for page in pages])
    return x, np.array([block[-1] for page in pages for block in page], np.int64)


@cache
def grown() -> Tree:
    """One in each process."""
    return Tree(*labelled_table())


def articles(pages: list[str]) -> list[str]:
    """Of each page the blocks that the tree takes for its article, joined by spaces."""
    found = [Blocks(page) for page in pages]
    chosen = grown().predict(features([b.rows for b in found])).tolist()
    out, at = [], 0
    for b in found:
        out.append(" ".join(compress(b.texts, chosen[at : at + len(b.texts)])))
        at += len(b.texts)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages: the article in its whole html.

    Null or empty html, and pages without an article: an empty text. White space, non-breaking too, is one space. Repeated rows
    each give a row; page_id and url may be null; other columns are left behind. Unclosed elements end with what holds them,
    and what the end of a page cuts off counts as far as it goes. Pages of any length are read whole, in time in proportion to it.
    Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = articles(part.column(2).to_pylist())
                columns = [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
