"""The upstream as a stream: each micro-batch is a cycle, in which every open window goes on from its cursor.

A cycle's plan is written down before it is read: its windows, each with the cursor that the last cycle left and its failures in a row.
A task reads one window's next pages and leaves a mark: the cursor it came to, and why it ended. The next plan is made of these
marks, so windows are read by as many tasks as there are, and no page passes the driver. A cycle that is read again, after a lost
executor or a restart, starts from the plan's cursors and ends at those of the marks, so neither loses nor adds a page.

With the option most_pages, a window that its cap cut off has twice the pages in the next cycle, up to so many: a backlog then takes about
its pages / most_pages cycles, and a task still reads no more than that at a time.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from ..functions.records import parsed_time
from .upstream import CAPPED, OVERLAP, PAGES, Lane, Walk, windows

#: Failures in a row after which a window is left alone.
FAILURES = 5

MARK = "cycle long, start long, end long, cursor string, page int, left string, failures int, events long, last string"


class Folder:
    """Small JSON documents in a store that pyarrow can open. A document is there wholly or not at all."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.system, self.path = fs.FileSystem.from_uri(uri)
        self.file_type = fs.FileType

    def read(self, name: str) -> dict | None:
        if self.system.get_file_info(f"{self.path}/{name}").type != self.file_type.File:
            return None
        with self.system.open_input_stream(f"{self.path}/{name}") as f:
            return json.loads(f.read())

    def write(self, name: str, document: dict) -> None:
        target = f"{self.path}/{name}"
        self.system.create_dir(target.rpartition("/")[0], recursive=True)
        own = f"{target.rpartition('/')[0]}/_{time.time_ns()}-{name.rpartition('/')[2]}"  # readers skip names with an underscore
        with self.system.open_output_stream(own) as f:
            f.write(json.dumps(document).encode())
        self.system.move(own, target)

    def names(self, prefix: str) -> list[str]:
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return [x.base_name for x in found if x.base_name.startswith(prefix)]


def _mark(cycle: int, lane: dict) -> str:
    return f"marks-{cycle:09d}/{lane['start']}-{lane['end']}.json"


class Planned(InputPartition):
    def __init__(self, cycle: int, lane: dict):
        self.cycle, self.lane = cycle, lane


class UpstreamStream(DataSourceStreamReader):
    """Offsets are cycles' numbers; windows and cursors of a cycle are in its plan."""

    def __init__(self, options: dict):
        self.options = options

    @property
    def folder(self) -> Folder:
        return Folder(self.options["state"])

    def initialOffset(self) -> dict:
        return {"cycle": 0}

    def latestOffset(self) -> dict:
        """The last cycle's number: a new one if the one before it has left all its marks and there is something to read."""
        folder = self.folder
        n = max((int(x.removeprefix("plan-").removesuffix(".json")) for x in folder.names("plan-")), default=0)
        plan = folder.read(f"plan-{n:09d}.json") if n else {"lanes": [], "upto": None}
        marks = [folder.read(_mark(n, lane)) for lane in plan["lanes"]]
        if all(marks) and (following := self._next(plan, marks)):
            folder.write(f"plan-{n + 1:09d}.json", following)
            n += 1
        return {"cycle": n}

    def _next(self, plan: dict, marks: list[dict]) -> dict | None:
        o = self.options
        most = int(o.get("failures", FAILURES))
        kept = ("start", "end", "cursor", "page", "failures", "events", "last")
        lanes = [{k: m[k] for k in kept} | self._cap(lane, m) for lane, m in zip(plan["lanes"], marks, strict=True) if m["left"] is not None and m["failures"] < most]
        until = int(time.time()) if o["until"] == "now" else int(o["until"])
        upto = int(o["since"]) if plan["upto"] is None else plan["upto"]
        if until > upto:
            lanes += [{"start": x.start, "end": x.end, "cursor": "", "page": 0, "failures": 0, "events": 0, "last": None} for x in windows(upto, until, int(o["window"]), int(o.get("overlap", OVERLAP)))]
        return {"lanes": lanes, "upto": max(until, upto)} if lanes else None

    def _cap(self, lane: dict, mark: dict) -> dict:
        """The cap on a window's next pages, where it isn't the option's."""
        now, most = lane.get("pages", int(self.options.get("pages", PAGES))), int(self.options.get("most_pages", 0))
        return {"pages": min(2 * now, most) if mark["left"] == CAPPED else now} if most > now else {"pages": lane["pages"]} if "pages" in lane else {}

    def partitions(self, start: dict, end: dict) -> list[Planned]:
        folder = self.folder
        return [Planned(n, lane) for n in range(start["cycle"] + 1, end["cycle"] + 1) for lane in folder.read(f"plan-{n:09d}.json")["lanes"]]

    def read(self, partition: Planned) -> Iterator[tuple]:
        folder, lane, name = self.folder, partition.lane, _mark(partition.cycle, partition.lane)
        before = folder.read(name)
        if before and before["page"] == lane["page"]:
            return  # nothing came of it
        options = self.options | ({"pages": lane["pages"]} if "pages" in lane else {}) | ({"pages": before["page"] - lane["page"]} if before else {})
        stop = before["cursor"] if before and before["left"] is not None else None  # a whole window's cursor is that of its last page
        walk = Walk(options, Lane(lane["start"], lane["end"], lane["cursor"], lane["page"], stop))
        events, last = lane["events"], lane["last"]
        for row in walk:
            known = row[2] and row[2].endswith("+00:00")  # such times compare as text
            events, last = events + 1, max(last or row[2], row[2]) if known else last
            yield row
        if before is not None:
            if walk.left not in (None, CAPPED):
                raise ConnectionError(f"a page that has been read can't be had again: {walk.left}")
            return
        failed = walk.left not in (None, CAPPED)
        failures = lane["failures"] + 1 if failed and walk.page == lane["page"] else int(failed)
        folder.write(name, {"cycle": partition.cycle, "start": lane["start"], "end": lane["end"], "cursor": walk.cursor, "page": walk.page, "left": walk.left, "failures": failures, "events": events, "last": last})


def cursors(spark: SparkSession, state: str) -> DataFrame:
    """Where each window stands: start, end, cycle, cursor, page, left (null: whole), failures in a row, healthy, events, last_event_time."""
    marks = spark.read.schema(MARK).option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9-]*.json").json(state)
    last = marks.groupBy("start", "end").agg(F.max_by(F.struct("cycle", "cursor", "page", "left", "failures", "events", "last"), "cycle").alias("x")).select("start", "end", "x.*")
    return last.select("start", "end", "cycle", "cursor", "page", "left", "failures", (F.col("failures") < FAILURES).alias("healthy"), "events", parsed_time(F.col("last")).alias("last_event_time"))


def kind_of(event_type: Column) -> Column:
    """An event's kind by its type, the first rule that holds."""
    name = F.lower(event_type)
    has = lambda *words: name.rlike("|".join(words))
    return F.when(has("delet", "purge"), "deletion").when(has("message"), "message").when(has("conversation", "chat"), "conversation").when(has("file", "attachment"), "file").otherwise("unknown")


def admitted_events(pulled: DataFrame) -> DataFrame:
    """Pulled rows as events, each id once (the earliest time, then the smallest raw text): kind, time or null, digest of the payload."""
    rows = pulled.where(F.col("source_event_id").isNotNull()).withColumn("event_time", parsed_time(F.col("created_at")))
    own = F.struct("type", "event_time", "conversation_id", "message_id", "workspace_id", "actor", "is_deletion", "raw")
    once = rows.groupBy("source_event_id").agg(F.min_by(own, F.struct(F.col("event_time").isNull(), "event_time", "raw")).alias("x")).select("source_event_id", "x.*")
    return once.withColumns({"kind": kind_of(F.col("type")), "payload_sha256": F.sha2("raw", 256)})
