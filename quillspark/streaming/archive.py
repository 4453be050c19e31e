"""Raw documents of a stream of events: objects first, then the rows that point to them, then the stream's own checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.keyed import Keyed

#: Where an event's document is: its key, the objects it was written with, and the digest of its bytes.
POINTER = "event_id bigint, object_key string, written string, sha256 string"


def archiving(store: Keyed, objects: str, documents: Callable[[DataFrame], DataFrame], step: Callable[[str], object] = lambda name: None) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch. `documents` gives event_id, object_key and body.

    A batch's objects have its number, so that one that is tried again replaces its own; its rows are added in one change, which names
    the batch, so that it adds them once. An event that has a pointer gets no other.
    """

    def archive(batch: DataFrame, number: int) -> None:
        folder = f"b-{number:09d}"
        if store.head()[1]["batches"].get("archive", -1) >= number:
            return
        new = documents(batch).select("event_id", "object_key", "body", F.sha2("body", 256).alias("sha256"))
        new.dropDuplicates(["event_id"]).write.mode("overwrite").option("compression", "gzip").json(f"{objects}/{folder}")
        step("objects written")
        made = batch.sparkSession.read.schema("event_id long, object_key string, sha256 string").json(f"{objects}/{folder}").select("event_id", "object_key", F.lit(folder).alias("written"), "sha256")
        store.change(lambda now: made.join(now.select("event_id"), "event_id", "left_anti"), made, append=True, batch=("archive", number))
        step("rows written")

    return archive


def archived(store: Keyed, objects: str) -> DataFrame:
    """Pointers with the bodies they point to."""
    rows = store.read()
    bodies = store.spark.read.schema("event_id long, body string").json(f"{objects}/b-*").select("event_id", "body", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("written"))
    return rows.join(bodies, ["event_id", "written"])
