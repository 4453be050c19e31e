"""A source of upstream events: windows of time, each read page by page behind a cursor, with retries.

As a batch, each window is read by a task up to a number of pages; a last row tells where to go on when the window isn't whole. As a
stream, a cap on pages ends a micro-batch and not the window: see polling.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Attempts at a page, and events of a page and pages of a window at most, unless options say otherwise.
ATTEMPTS, LIMIT, PAGES = 5, 100, 1000
#: Seconds that a pull reaches back before its window.
OVERLAP = 600
#: Where values lie in an answer and its events, as dotted paths: fixed values, each of which the option `fields` can replace.
FIELDS = {
    "items": "data",
    "next_cursor": "next_cursor",
    "has_more": "has_more",
    "id": "id",
    "created_at": "created_at",
    "type": "type",
    "conversation_id": "conversation_id",
    "message_id": "message_id",
    "workspace_id": "workspace_id",
    "actor": "user.email",
    "deleted": "deleted",
}

EVENT = (
    "source_event_id string, type string, created_at string, conversation_id string, message_id string, workspace_id string, actor string, is_deletion boolean, raw string,"
    " window_start long, window_end long, page int, cursor string, error string"
)
#: What a row says of a window that its cap on pages cut off.
CAPPED = "page_cap"


class Refused(Exception):
    """An answer that another attempt will not change."""


def requested(url: str) -> dict:
    """The JSON document at an address: of a web server, or of a store that pyarrow can open."""
    if not url.startswith("http"):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(url.partition("?")[0])
        with system.open_input_stream(path) as f:
            return json.loads(f.read())
    try:
        with urllib.request.urlopen(url, timeout=30) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        if e.code != 429 and e.code < 500:
            raise Refused(f"rejected with {e.code}") from e
        raise


def retried(url: str, fetch: Callable[[str], dict] = requested, attempts: int = ATTEMPTS, pause: float = 1.0) -> dict:
    """The document, after waits that double from `pause` to 30 s, with jitter; 429, 5xx and network faults are tried again."""
    for k in range(attempts):
        try:
            return fetch(url)
        except Refused:
            raise
        except (OSError, ValueError) as e:
            last = e
        if k + 1 < attempts:
            time.sleep(min(pause * 2**k, 30) * (0.5 + random.random()))
    raise ConnectionError(f"unavailable after {attempts} attempts: {type(last).__name__}")


def fields_of(options: dict) -> dict[str, str]:
    """The field map with the option's paths; what isn't JSON or names no field changes nothing."""
    try:
        given = json.loads(options.get("fields") or "{}")
    except ValueError:
        given = {}
    return FIELDS | {k: str(v) for k, v in (given.items() if isinstance(given, dict) else ()) if k in FIELDS}


def dug(document, path: str):
    """The value at a dotted path, or None."""
    for part in path.split(".") if "." in path else (path,):
        document = document.get(part) if isinstance(document, dict) else None
    return document


def _text(value) -> str | None:
    return None if value is None else str(value)


def iso_time(value) -> str | None:
    """A time in UTC as text: numbers are seconds, or milliseconds above 1e11; text that is no ISO time stays as it is."""
    try:
        if isinstance(value, int | float) and not isinstance(value, bool):
            return datetime.fromtimestamp(value / 1000 if value > 1e11 else value, UTC).isoformat()
        if isinstance(value, str):
            found = datetime.fromisoformat(value.strip())
            return (found if found.tzinfo else found.replace(tzinfo=UTC)).astimezone(UTC).isoformat()
    except (OverflowError, ValueError, OSError):
        return value if isinstance(value, str) else None
    return None


def event(item, fields: dict[str, str]) -> tuple | None:
    """The first columns of EVENT for an item; None without an id."""
    own = {k: dug(item, fields[k]) for k in ("id", "type", "created_at", "conversation_id", "message_id", "workspace_id", "actor", "deleted")}
    if not own["id"]:
        return None
    kind = str(own["type"] or "unknown")
    gone = bool(own["deleted"]) or "delet" in kind.lower()
    return str(own["id"]), kind, iso_time(own["created_at"]), *(_text(own[k]) for k in ("conversation_id", "message_id", "workspace_id", "actor")), gone, json.dumps(item, sort_keys=True)


class Lane(InputPartition):
    """A window from a cursor on: after `page` pages, and up to the cursor `stop` if one is given."""

    def __init__(self, start: int, end: int, cursor: str = "", page: int = 0, stop: str | None = None):
        self.start, self.end, self.cursor, self.page, self.stop = start, end, cursor, page, stop


class Walk:
    """Rows of a lane, page by page, until it is whole, capped, at its stop, or fails.

    Afterwards `left` is None where the window is whole, and else tells why not; `cursor` and `page` are where to go on.
    """

    def __init__(self, options: dict, lane: Lane):
        self.options, self.lane, self.cursor, self.page, self.left = options, lane, lane.cursor, lane.page, CAPPED

    def __iter__(self) -> Iterator[tuple]:
        o, lane, fields = self.options, self.lane, fields_of(self.options)
        for _ in range(max(1, int(o.get("pages", PAGES)))):
            if lane.stop is not None and self.cursor == lane.stop and self.page > lane.page:
                return
            asked = {"since": lane.start, "until": lane.end, "limit": int(o.get("limit", LIMIT)), "cursor": self.cursor}
            try:
                answer = retried(o["address"].format(**asked) + "?" + urlencode(asked), attempts=int(o.get("attempts", ATTEMPTS)), pause=float(o.get("pause", 1)))
            except (ConnectionError, Refused) as e:
                self.left = f"{type(e).__name__}: {e}"
                return
            items = dug(answer, fields["items"])
            items = items if isinstance(items, list) else []
            for x in items:
                if row := event(x, fields):
                    yield *row, lane.start, lane.end, self.page, None, None
            self.page += 1
            following = _text(dug(answer, fields["next_cursor"])) or ""
            if not dug(answer, fields["has_more"]) or not items:
                self.left = None
                return
            if following in ("", self.cursor):
                self.left = "Stuck: more is promised without another cursor"
                return
            self.cursor = following


class UpstreamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Lane]:
        """One task a window. The first reaches back by the overlap, so that late events are met again. With the option `lanes`,
        a JSON list of [start, end, cursor, page], these instead: what an earlier pull left."""
        if given := self.options.get("lanes"):
            return [Lane(*x) for x in json.loads(given)]
        since, until, width = (int(self.options[k]) for k in ("since", "until", "window"))
        return windows(since, until, width, int(self.options.get("overlap", OVERLAP)))

    def read(self, partition: Lane) -> Iterator[tuple]:
        """Events of a window. What has been read stays when a page can't be had or the cap is met: a last row with the reason and
        the cursor tells where to go on."""
        walk = Walk(self.options, partition)
        yield from walk
        if walk.left is not None:
            yield *(None,) * 9, partition.start, partition.end, walk.page, walk.cursor, walk.left


def pulled(spark: SparkSession, folder: str, **options) -> DataFrame:
    """What the batch source has of its windows, whole but for failures: windows that the cap on pages cut off go on from their cursors,
    in as many pulls as that takes. Each pull is kept in the folder; only windows that are left, a row each, pass the driver."""
    parts: list[str] = []
    left: list[list] = []
    while left or not parts:
        lanes = {"lanes": json.dumps(left)} if left else {}
        parts.append(f"{folder}/{len(parts)}")
        spark.read.format(Upstream.name()).options(**options, **lanes).load().write.parquet(parts[-1])
        cut = spark.read.schema(EVENT).parquet(parts[-1]).where(f"error = '{CAPPED}'")
        left = [list(r) for r in cut.select("window_start", "window_end", "cursor", "page").collect()]
    return spark.read.schema(EVENT).parquet(*parts).where(f"error is null or error <> '{CAPPED}'")


def windows(since: int, until: int, width: int, overlap: int) -> list[Lane]:
    starts = list(range(since, until, width)) or [since]
    return [Lane(s - overlap if s == since else s, min(s + width, until)) for s in starts]


class Upstream(DataSource):
    """spark.read.format("upstream") with options address (a pattern over since, until, limit and cursor), since, until, window
    (seconds), and limit, pages, overlap, attempts, pause, fields, lanes. Events may come twice: deduplicate by source_event_id.
    spark.readStream takes the same, with until "now" if wished, and state: a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "upstream"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema) -> UpstreamReader:
        return UpstreamReader(dict(self.options))

    def streamReader(self, schema):
        from .polling import UpstreamStream

        return UpstreamStream(dict(self.options))
