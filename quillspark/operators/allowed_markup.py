"""Stored markup: only allowed elements and attributes, with safe addresses; per-body helpers, run in Arrow batches."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from .bodies import EMPTY, slices

#: Elements and attributes that stored markup keeps, schemes of its addresses, and the longest markup read.
ELEMENTS = {
    "p", "br", "hr", "span", "div", "strong", "b", "em",
    "i", "u", "s", "del", "ins", "mark", "sub", "sup",
    "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol",
    "li", "dl", "dt", "dd", "blockquote", "pre", "code", "kbd",
    "samp", "table", "thead", "tbody", "tfoot", "tr", "th", "td",
    "caption", "colgroup", "col", "a", "img", "figure", "figcaption", "cite",
    "abbr", "time",
}
EVERYWHERE = {"class", "title", "dir", "lang"}
ATTRIBUTES = {
    "a": {"href", "rel", "target"},
    "img": {"src", "alt", "width", "height"},
    "code": {"class", "data-language"},
    "pre": {"class", "data-language"},
    "th": {"colspan", "rowspan", "scope"},
    "td": {"colspan", "rowspan"},
    "col": {"span"},
    "time": {"datetime"},
    "ol": {"start", "type"},
}
SCHEMES = {"http", "https", "mailto"}
LONGEST = 2_000_000
#: What must not be left even as text.
ACTIVE = re.compile(r"(?i)javascript:|vbscript:|data:text/html|<\s*script")


def safe_address(value: str) -> bool:
    """Has it an allowed scheme, or none? White space, control characters and backticks hide no scheme."""
    plain = re.sub(r"[`\x00-\x20\x7f-\xa0\s]+", "", html.unescape(value)).replace("�", "").lower()
    try:
        scheme = urlsplit(plain).scheme
    except ValueError:
        return False
    # What looks like a scheme but is none that parses (such as one that begins with a digit) is refused, unless a path or query holds it.
    return scheme in SCHEMES if scheme else ":" not in re.split(r"[/?#]", plain, maxsplit=1)[0]


class _Allowed(HTMLParser):
    """Elements that are not allowed go, their text stays; comments go; what is open at the end is closed."""

    CDATA_CONTENT_ELEMENTS = ()  # a script's content is text like any other once its element is gone
    RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.count: Counter[str] = Counter()  # of open elements, so that a stray end costs nothing
        self.feed(markup)
        self.close()
        self.out += [f"</{t}>" for t in reversed(self.open)]

    def handle_starttag(self, tag, attrs):
        if tag not in ELEMENTS:
            return
        kept: dict[str, str] = {}
        for name, value in attrs:
            allowed = name in EVERYWHERE or name in ATTRIBUTES.get(tag, ())
            if allowed and name not in kept and (name not in ("href", "src") or safe_address(value or "")):
                kept[name] = value or ""
        self.out.append(f"<{tag}" + "".join(f' {n}="{html.escape(v)}"' for n, v in kept.items()) + ">")
        if tag not in EMPTY:
            self.open.append(tag)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.count[tag]:
            while True:
                last = self.open.pop()
                self.count[last] -= 1
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data):
        self.out.append(html.escape(data, quote=False))


def sanitised(markup: str | None, longest: int = LONGEST) -> str | None:
    """Allowed markup of the first `longest` characters, without active schemes; None where nothing is left."""
    if not markup:
        return None
    return ACTIVE.sub("", "".join(_Allowed(markup[:longest]).out)) or None


def with_sanitised(bodies: DataFrame) -> DataFrame:
    """key and sanitised of each body (columns key, html). Null or empty markup: null. A body is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sanitised(x) for x in b.column(1).to_pylist()], pa.string())], ["key", "sanitised"])

    return bodies.select("key", "html").mapInArrow(run, "key string, sanitised string")
