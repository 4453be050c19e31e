"""Bodies of rendered messages and whole pages as parts in order, with their structure: a small tree for each, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Block elements by the kind of part that they are; elements without an end; most attachments of a message.
KINDS = {"p": "text", "pre": "code", "ul": "list", "ol": "list", "table": "table", "blockquote": "quote", **{f"h{i}": "heading" for i in range(1, 7)}}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ATTACHMENTS = 20
#: Bytes of rows that are in Python's hands at a time.
SLICE = 1 << 20
#: Elements inside a line. All others bound what an element without an end tag takes in.
INLINE = {"a", "abbr", "b", "cite", "code", "del", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var"}
#: What the start of an element ends, where it stands innermost; the start of any block ends a paragraph.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
BLOCKS = {*KINDS, *ENDS, "address", "article", "aside", "details", "div", "dl", "fieldset", "figure", "footer", "form", "header", "hr", "main", "menu", "nav", "section"} - {"option"}
#: What has no text to read.
UNREAD = {"head", "noscript", "script", "style", "template"}


class Node:
    """An element: tag, attributes, and its children, which are elements and texts."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.holds = False  # a block that is a part, at any depth

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def text(self, without: tuple[str, ...] = ()) -> str:
        """The text inside, but for children with one of these tags. No recursion: pages may nest as deep as they like."""
        out, waiting = [], [c for c in reversed(self.children) if isinstance(c, str) or c.tag not in without]
        while waiting:
            c = waiting.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                waiting += reversed(c.children)
        return "".join(out)

    def all(self, *tags: str) -> Iterator[Node]:
        """Elements below with one of these tags (none given: all), in order."""
        waiting = self.elements[::-1]
        while waiting:
            c = waiting.pop()
            if not tags or c.tag in tags:
                yield c
            waiting += c.elements[::-1]


class _Tree(HTMLParser):
    """A tree of a page or a body. Each start or end takes constant time on average, however elements nest."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.bounds: list[int] = []  # where open elements stand that aren't inside a line
        self.count: Counter[str] = Counter()  # of open elements, so that a stray end costs nothing
        self.feed(markup)
        self.close()

    def _end(self) -> str:
        node = self.open.pop()
        self.count[node.tag] -= 1
        if self.bounds and self.bounds[-1] == len(self.open):
            self.bounds.pop()
        return node.tag

    def handle_starttag(self, tag, attrs):
        if tag == "form" and self.count[tag]:
            return  # forms don't nest
        ended = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        while ended and self.bounds and self.open[self.bounds[-1]].tag in ended:
            at = self.bounds[-1]
            while len(self.open) > at:
                self._end()
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})  # the first of repeated attributes counts
        self.open[-1].children.append(node)
        if tag in KINDS:
            for around in reversed(self.open):
                if around.holds:
                    break
                around.holds = True
        if tag not in EMPTY:
            if tag not in INLINE:
                self.bounds.append(len(self.open))
            self.open.append(node)
            self.count[tag] += 1

    def handle_endtag(self, tag):
        while self.count[tag] and self._end() != tag:
            pass

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(markup: str | None) -> Node:
    return _Tree(markup or "").root


def plain(text: str) -> str:
    return " ".join(text.split())


def _items(node: Node) -> list[dict]:
    """Items in order: an item's first inner list lies one deeper, as does a list between items."""
    out, waiting = [], [(c, 0) for c in reversed(node.elements)]
    while waiting:
        c, depth = waiting.pop()
        if c.tag == "li":
            out.append({"depth": depth, "text": plain(c.text(without=("ul", "ol")))})
            c = next((x for x in c.elements if x.tag in ("ul", "ol")), None)
        elif c.tag not in ("ul", "ol"):
            continue
        waiting += [(x, depth + 1) for x in reversed(c.elements)] if c else []
    return out


def _own(node: Node, *tags: str) -> Iterator[Node]:
    """Elements below with one of these tags that are in no table further in, in order."""
    waiting = node.elements[::-1]
    while waiting:
        c = waiting.pop()
        if c.tag in tags:
            yield c
        if c.tag != "table":
            waiting += c.elements[::-1]


def _grid(table: Node) -> dict:
    """Headers from the head and rows from the body; a table with neither gives its first row as headers. A table in a cell is
    that cell's text and gives no rows, so the time doesn't grow with the square of their depth."""
    cells = lambda row: [plain(c.text()) for c in row.elements if c.tag in ("td", "th")]
    headers = [plain(c.text()) for head in _own(table, "thead") for c in _own(head, "th")]
    rows = [cells(r) for body in _own(table, "tbody") for r in _own(body, "tr")]
    if not headers and not rows:
        first, *rest = [[plain(c.text()) for c in r.elements] for r in _own(table, "tr")] or [[]]
        headers, rows = first, rest
    return {"headers": headers, "rows": rows}


def _language(node: Node) -> str:
    code = next(node.all("code"), node)
    named = re.search(r"language-([A-Za-z0-9+#-]+)", code.attrs.get("class", ""))
    return (code.attrs.get("data-language") or (named[1] if named else "")).lower()[:64]


def blocks(root: Node) -> Iterator[Node]:
    """The blocks of a whole page in order: what holds blocks but is none itself is opened, and what stands loose in it is one block a run."""
    waiting, loose = [root], Node("", {})
    while waiting:
        c = waiting.pop()
        if isinstance(c, str) or c.tag in INLINE or c.tag in EMPTY:
            loose.children.append(c)
            continue
        if loose.children:
            yield loose
            loose = Node("", {})
        if c.tag in UNREAD:
            continue
        if c.tag in KINDS or not c.holds:
            yield c
        else:
            waiting += reversed(c.children)
    if loose.children:
        yield loose


def _parts(nodes: Iterable[Node]) -> list[dict]:
    """Parts in order: index, kind, language, text, structured. Each element is one; a list or a table is one as a whole."""
    out = []
    for node in nodes:
        kind = KINDS.get(node.tag, "text")
        text = node.text().rstrip("\n") if kind == "code" else plain(node.text())
        structured = {}
        if kind == "list":
            structured = {"items": _items(node), "ordered": node.tag == "ol"}
        elif kind == "table":
            structured = _grid(node)
        elif kind == "heading":
            structured = {"level": int(node.tag[1])}
        if text:
            out.append({"index": len(out), "kind": kind, "language": _language(node) if kind == "code" else "", "text": text, "structured": structured})
    return out


def parts_in(body: Node) -> list[dict]:
    """Each child of a message's body is a part; a body without elements is one as a whole."""
    return _parts(body.elements or [body])


def parts_of(markup: str) -> list[dict]:
    return parts_in(tree(markup))


def parts_of_page(page: Node) -> list[dict]:
    return _parts(blocks(page))


def text_of(parts: list[dict]) -> str:
    """Blocks apart by an empty line: fenced code, tables as a grid, lists numbered over all depths or dashed, others bare."""
    out = []
    for p in parts:
        s, text = p["structured"], p["text"]
        if p["kind"] == "code":
            text = f"```{p['language']}\n{text}\n```"
        elif p["kind"] == "table" and (s["headers"] or s["rows"]):
            text = "\n".join(" | ".join(row) for row in [s["headers"], ["---"] * len(s["headers"]), *s["rows"]])
        elif p["kind"] == "list" and s["items"]:
            text = "\n".join("  " * x["depth"] + (f"{k}. " if s["ordered"] else "- ") + x["text"] for k, x in enumerate(s["items"], 1))
        out.append(text)
    return "\n\n".join(out).strip()


def _tile(node: Node) -> bool:
    named = node.attrs.get("data-testid", "")
    return named == "file-attachment" or named.startswith("attachment") or (node.tag == "a" and "download" in node.attrs)


def attachments_of(root: Node, conversation: str) -> list[str]:
    """Ids of a body's attachments: tiles that name a file, then images that were generated; made up where the page has none."""
    every = list(root.all())
    tiles = [(t, t.attrs.get("data-filename") or t.attrs.get("download") or plain(t.text())[:200]) for t in every if _tile(t)]
    out = [f"dom-{conversation}-{t.attrs.get('data-file-id') or name}"[:128] for t, name in tiles if name]
    out += [f"gen-{conversation}-{i.attrs.get('alt', 'generated-image')}"[:128] for i in every if i.attrs.get("data-testid") == "generated-image" or (i.tag == "img" and "Generated" in i.attrs.get("alt", ""))]
    return out[:ATTACHMENTS]


PART = "struct<index:int,kind:string,language:string,text:string,structured:string>"


def flat(parts: list[dict]) -> list[dict]:
    """Parts with their structure as JSON."""
    return [{**p, "structured": json.dumps(p["structured"], sort_keys=True, separators=(",", ":"), ensure_ascii=False)} for p in parts]


def slices(b: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most about `most` bytes, a row at least: what Python makes of markup takes many times its size, and a batch
    holds as many rows as a table has to give."""
    rows = max(1, most * b.num_rows // max(1, b.nbytes))
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def in_batches(rows: DataFrame, read: Callable[..., dict], schema: str) -> DataFrame:
    """The first column, and what `read` makes of the others of each row."""
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            first, *others = (c.to_pylist() for c in b.columns)
            made = [{types.names[0]: k, **read(*given)} for k, *given in zip(first, *others, strict=True)]
            yield pa.RecordBatch.from_pylist(made, schema=types)

    return rows.mapInArrow(run, schema)


def read_bodies(bodies: DataFrame) -> DataFrame:
    """key, parts (index, kind, language, text, structured as JSON), text, attachments of each body (columns key, conversation,
    html). Null markup: no parts, '' and no attachments. A body is held whole."""

    def read(conversation: str | None, markup: str | None) -> dict:
        root = tree(markup)
        parts = parts_in(root)
        return {"parts": flat(parts), "text": text_of(parts), "attachments": attachments_of(root, conversation or "unknown")}

    return in_batches(bodies.select("key", "conversation", "html"), read, f"key string, parts array<{PART}>, text string, attachments array<string>")


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, parts (as of a body), text, links (whole, of anchors to http or https) of each page (columns page_id, html), by blocks
    of the whole page, and whether there is markup at all. Null markup: no parts, no links and ''. A page is held whole."""

    def read(markup: str | None) -> dict:
        root = tree(markup)
        parts = parts_of_page(root)
        title = next((plain(t.text()) for t in root.all("title")), "")
        links = [a.attrs["href"] for a in root.all("a") if re.match(r"(?i)https?:", a.attrs.get("href", ""))]
        return {"title": title, "parts": flat(parts), "text": text_of(parts), "links": links, "given": markup is not None}

    return in_batches(pages.select("page_id", "html"), read, f"page_id long, title string, parts array<{PART}>, text string, links array<string>, given boolean")
