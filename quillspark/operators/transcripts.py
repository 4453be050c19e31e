"""Rendered transcripts: a page's conversation, its messages in order, and what it says of its workspace; a tree for each page, in Arrow batches.

A place in a page is described by rules in order of trust; the first rule that finds something decides. Whatever a user is still writing
is never read: fields, editable elements, and a form around them that holds no messages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import parsed_time
from ..functions.text import content_hash
from .bodies import PART, Node, attachments_of, flat, in_batches, parts_in, plain, text_of, tree

#: Roles, bounds of citations, and where an address names its conversation.
ROLES = ("user", "assistant", "tool", "system")
CITATIONS, TITLE, ADDRESS = 100, 512, 2048
IN_ADDRESS = r"/(?:c|chat)/([0-9a-fA-F-]{16,64})"

Rule = Callable[[Node], bool]
MESSAGE = "struct<position:int,message_id:string,role:string,author:string,model:string,sent_at:string,streaming:boolean,branch_index:long,branch_total:long,text:string,parts:array<{0}>,citations:array<{1}>,attachments:array<string>>".format(
    PART, "struct<index:int,title:string,url:string,source_id:string>"
)
WORKSPACE = "struct<label:string,workspace_id:string,signals:array<string>,personal:boolean>"


def _has(name: str, value: str | None = None) -> Rule:
    return lambda n: name in n.attrs and value in (None, n.attrs[name])


def _named(value: str) -> Rule:
    return _has("data-testid", value)


def _classed(name: str) -> Rule:
    return lambda n: name in n.attrs.get("class", "").split()


def _starts(n: Node, prefix: str) -> bool:
    return n.attrs.get("data-testid", "").startswith(prefix)


def _all(node: Node, *rules: Rule) -> list[Node]:
    """Elements below that the first rule finds that finds any."""
    every = list(node.all())
    return next((found for r in rules if (found := [n for n in every if r(n)])), [])


def _first(node: Node, *rules: Rule) -> Node | None:
    return next(iter(_all(node, *rules)), None)


def _inside(root: Node, outer: Rule, inner: Rule) -> Node | None:
    """The first element by `inner` in one by `outer`; each element is looked at once."""
    waiting = [(n, False) for n in reversed(root.elements)]
    while waiting:
        n, within = waiting.pop()
        if within and inner(n):
            return n
        waiting += [(c, within or outer(n)) for c in reversed(n.elements)]
    return None


def _field(n: Node) -> bool:
    return n.tag in ("textarea", "input") or n.attrs.get("contenteditable") == "true" or _named("prompt-textarea")(n)


def _turn(n: Node) -> bool:
    return _starts(n, "conversation-turn")


_MESSAGE = _has("data-message-id")


def _readable(root: Node, rule: Rule) -> Iterator[Node]:
    """The outermost elements by a rule that aren't part of what is being written."""
    waiting = root.elements[::-1]
    while waiting:
        n = waiting.pop()
        if _field(n):
            continue
        if n.tag == "form":
            inner = list(n.all())  # forms don't nest, so each element is looked at once
            if any(map(_field, inner)) and not any(_turn(x) or _MESSAGE(x) for x in inner):
                continue
        if rule(n):
            yield n
        else:
            waiting += n.elements[::-1]


def _below(n: Node, name: str) -> str | None:
    """An attribute of the first element below that has it."""
    found = _first(n, _has(name))
    return found.attrs[name] if found else None


def _citations(body: Node) -> list[dict]:
    anchors = _all(body, lambda n: n.tag == "a" and "data-citation" in n.attrs, lambda n: n.tag == "a" and n.attrs.get("target") == "_blank" and "noopener" in n.attrs.get("rel", "").split())
    web = [(k, a, a.attrs["href"]) for k, a in enumerate(anchors) if re.match(r"(?i)https?:", a.attrs.get("href", ""))]
    return [{"index": k, "title": plain(a.text())[:TITLE] or None, "url": url[:ADDRESS], "source_id": a.attrs.get("data-citation") or None} for k, a, url in web[:CITATIONS]]


def _message(turn: Node, position: int, conversation: str | None) -> dict | None:
    role = turn.attrs["data-message-author-role"] if "data-message-author-role" in turn.attrs else _below(turn, "data-message-author-role")
    if role not in ROLES:
        return None
    marked = (_classed("markdown"), _has("data-message-content"), _classed("prose"))
    body = _first(turn, *((_classed("whitespace-pre-wrap"), _has("data-message-content")) if role == "user" else ()), *marked) or turn
    parts = parts_in(body)
    text = text_of(parts)
    if not text:
        return None
    time = _first(turn, lambda n: n.tag == "time" and "datetime" in n.attrs, _has("data-message-timestamp"))
    counter = _first(turn, _named("conversation-turn-counter"), _classed("tabular-nums"), lambda n: "of" in n.attrs.get("aria-label", "") and n.attrs.get("role") == "status")
    branch = re.search(r"([0-9]{1,9})\s*/\s*([0-9]{1,9})", plain(counter.text())) if counter else None
    streaming = turn.attrs.get("data-is-streaming") == "true" or _first(turn, _has("data-is-streaming", "true"), _classed("result-streaming"), _named("stop-button")) is not None
    return {
        "position": position, "message_id": turn.attrs.get("data-message-id") or _below(turn, "data-message-id") or None, "role": role, "author": turn.attrs.get("data-author-name"), "model": turn.attrs.get("data-message-model-slug"),
        "sent_at": (time.attrs.get("datetime") or time.attrs.get("data-message-timestamp")) if time else None, "streaming": streaming, "branch_index": int(branch[1]) if branch else None, "branch_total": int(branch[2]) if branch else None,
        "text": text, "parts": flat(parts), "citations": _citations(body), "attachments": attachments_of(turn, conversation or "unknown"),
    }


def _label(root: Node) -> Node | None:
    profile, switcher = _named("accounts-profile-button"), _inside(root, lambda n: n.tag == "nav", _named("workspace-switcher"))
    named = _inside(root, profile, lambda n: n.tag == "div" and _classed("truncate")(n)) or _first(root, _named("workspace-name"), _has("data-workspace-name"))
    return named or (next(switcher.all("span"), None) if switcher else None)


def _workspace(root: Node, url: str) -> dict:
    label = _label(root)
    label = plain(label.text()) or None if label else None
    marked = _first(root, _has("data-workspace-id"))
    own = (marked.attrs["data-workspace-id"].strip() or None) if marked else None
    managed = _first(root, _named("enterprise-badge"), _has("data-managed-account", "true"), lambda n: _named("accounts-profile-button")(n) and "Enterprise" in n.attrs.get("aria-label", ""))
    signals = {"workspace_label_match": label, "workspace_id_match": own, "enterprise_workspace_marker": managed, "managed_account_url_path": re.match(r"[a-z]+://[^/?#]*[^?#]*/g/g-", url)}
    personal = _first(root, _has("data-workspace-kind", "personal"), _named("workspace-personal"))
    return {"label": label, "workspace_id": own, "signals": [k for k, v in signals.items() if v is not None], "personal": personal is not None}


def read_transcripts(pages: DataFrame) -> DataFrame:
    """key, conversation, title, model, messages, workspace of each page (columns key, url, html).

    A turn inside another belongs to the outer one; turns without a known role or without text are left out and keep their
    position. Null markup: no messages, no title; a null address names no conversation. A page is held whole.
    """

    def read(url: str | None, markup: str | None) -> dict:
        root, url = tree(markup), url or ""
        named = re.search(IN_ADDRESS, url)
        conversation = named[1] if named else None
        turns = list(_readable(root, _turn if any(map(_turn, root.all())) else _MESSAGE))
        messages = [m for k, t in enumerate(turns) if (m := _message(t, k, conversation))]
        title = _inside(root, lambda n: n.tag == "nav", _has("aria-current", "page")) or _first(root, _named("conversation-title")) or _inside(root, lambda n: n.tag == "header", lambda n: n.tag == "h1")
        return {
            "conversation": conversation, "title": plain(title.text()) or None if title else None, "model": next((m["model"] for m in messages if m["model"]), None),
            "messages": messages, "workspace": _workspace(root, url),
        }

    return in_batches(pages.select("key", "url", "html"), read, f"key string, conversation string, title string, model string, messages array<{MESSAGE}>, workspace {WORKSPACE}")


def read_workspaces(pages: DataFrame) -> DataFrame:
    """key, workspace of each page (columns key, url, html), as read_transcripts has it, without reading the messages."""
    return in_batches(pages.select("key", "url", "html"), lambda url, markup: {"workspace": _workspace(tree(markup), url or "")}, f"key string, workspace {WORKSPACE}")


def submissions(transcripts: DataFrame, start: Column | int = 0) -> DataFrame:
    """A row for each message as it is submitted: sequence_index by its place among the page's messages, from `start` on; partial
    while it is still being written; content_sha256; branch_key where it has one."""
    start = F.lit(start) if isinstance(start, int) else start
    m = transcripts.select("key", "conversation", start.alias("start"), F.posexplode("messages").alias("place", "m")).select("key", "conversation", "start", "place", "m.*")
    branch = F.when(F.col("branch_index").isNotNull(), F.concat(F.lit("branch-"), F.col("branch_index").cast("string"), F.lit("-of-"), F.col("branch_total").cast("string")))
    return m.withColumns({
        "sequence_index": (F.col("start") + F.col("place")).cast("long"), "completion_status": F.when(F.col("streaming"), "partial").otherwise("complete"),
        "branch_key": branch, "source_created_at": parsed_time(F.col("sent_at")), "content_sha256": content_hash(F.col("text")),
    }).drop("start", "place", "streaming", "sent_at")
