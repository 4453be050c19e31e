"""Parts, text, citations and safe markup of HTML pages: per-page helpers, run in Arrow batches."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .bodies import slices

#: Elements by what they become, what is dropped with its content, and what markup may keep.
BLOCKS = {"p": "paragraph", "li": "list", "pre": "code", "blockquote": "quote", "td": "table", "th": "table", **{f"h{i}": "heading" for i in range(1, 7)}}
DROPPED = {"script", "style", "iframe", "object", "embed", "noscript", "template", "svg", "form", "textarea"}
ALLOWED = {"p", "br", "b", "i", "em", "strong", "code", "pre", "ul", "ol", "li", "a", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "table", "thead", "tbody", "tr", "td", "th", "div", "span"}
ATTRIBUTES = {"a": {"href", "title"}, "code": {"class"}}
VOID = {"br", "img", "hr", "meta", "link", "input"}
#: Elements that never have an end tag, and those that a sibling of the same name ends.
EMPTY = VOID | {"area", "base", "col", "embed", "param", "source", "track", "wbr"}
SIBLINGS = {"p", "li", "td", "th", "tr", "option"}


class Page(HTMLParser):
    """One pass over a page: its parts in order, links and allowed markup."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.links: list[tuple[str, str]] = []
        self.safe: list[str] = []
        self.title = ""
        self.skip, self.depth, self.open, self.kind, self.language, self.level, self.in_title = 0, 0, [], "paragraph", "", 0, False
        self.buffer: list[str] = []
        self.count: Counter[str] = Counter()  # of open elements, so that a stray end costs nothing
        self.feed(markup)
        self.close()
        self._flush()

    def _flush(self) -> None:
        text = "".join(self.buffer)
        text = text.strip("\n") if self.kind == "code" else re.sub(r"\s+", " ", text).strip()
        if text:
            self.parts.append({"index": len(self.parts), "kind": self.kind, "language": self.language, "text": text, "level": self.level})
        self.buffer, self.kind, self.language, self.level = [], "paragraph", "", 0

    def handle_starttag(self, tag, attrs):
        if tag not in EMPTY:
            if len(self.open) > self.skip and self.open[-1] == ("p" if tag == "form" else tag) and self.open[-1] in SIBLINGS:
                self.count[self.open.pop()] -= 1
            self.open.append(tag)
            self.count[tag] += 1
            if tag in DROPPED and not self.skip:
                self.skip = len(self.open)  # until this element or one around it ends
        if self.skip or tag in DROPPED:
            return
        given = {k: v or "" for k, v in attrs}
        self.in_title |= tag == "title"
        if tag in ("ul", "ol"):
            self.depth += 1
        if tag in BLOCKS or tag in ("div", "br", "tr", "ul", "ol", "table"):
            if tag != "br" or self.kind != "code":
                self._flush()
        if tag in BLOCKS:
            self.kind = BLOCKS[tag]
            self.level = int(tag[1]) if self.kind == "heading" else self.depth if tag == "li" else 0
        if tag == "code" and (m := re.search(r"language-([\w+-]+)", given.get("class", ""))):
            self.language = m[1]
        if tag == "a" and re.match(r"https?://", given.get("href", "")):
            self.links.append((given["href"][:2048], given.get("title", "")[:512]))
        if tag in ALLOWED:
            kept = "".join(f' {k}="{html.escape(given[k])}"' for k in sorted(given) if k in ATTRIBUTES.get(tag, ()) and (k != "href" or re.match(r"(https?:|mailto:|/|#)", given[k].strip())))
            self.safe.append(f"<{tag}{kept}>")

    def handle_endtag(self, tag):
        if self.count[tag]:
            last = None
            while last != tag:
                last = self.open.pop()
                self.count[last] -= 1
            if len(self.open) < self.skip:
                self.skip = 0
        if self.skip or tag in DROPPED:
            return
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS or tag in ("div", "ul", "ol", "table"):
            self._flush()
        if tag in ("ul", "ol"):
            self.depth = max(0, self.depth - 1)
        if tag in ALLOWED and tag not in VOID:
            self.safe.append(f"</{tag}>")

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title += data
            return
        self.buffer.append(data)
        self.safe.append(html.escape(data, quote=False))


def parts_to_text(parts: list[dict]) -> str:
    """Fenced code, bulleted lists by depth, table cells in rows, headings with marks, other blocks as they are."""
    out = []
    for p in parts:
        if p["kind"] == "code":
            out.append(f"```{p['language']}\n{p['text']}\n```")
        elif p["kind"] == "list":
            out.append("  " * max(0, p["level"] - 1) + "- " + p["text"])
        elif p["kind"] == "heading":
            out.append("#" * p["level"] + " " + p["text"])
        elif p["kind"] == "quote":
            out.append("> " + p["text"])
        else:
            out.append(p["text"])
    return "\n".join(out)


def strict_markup(pages: DataFrame, most_links: int = 100) -> DataFrame:
    """page_id, safe_html (fewer elements than stored markup keeps; scripts and the like go with their content), links of each page.
    Null markup: '' and none."""
    schema = "page_id long, safe_html string, links array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            own = [Page(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["".join(x.safe) for x in own], pa.string()), pa.array([[u for u, _ in x.links[:most_links]] for x in own], pa.list_(pa.string()))], ["page_id", "safe_html", "links"])

    return pages.select("page_id", "html").mapInArrow(run, schema)
