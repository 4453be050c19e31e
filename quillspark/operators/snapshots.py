"""Snapshots of conversations: documents with versions that follow each other, and the mark of what they cover."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.keyed import Keyed

#: A conversation's row: the time of its last change, the last change that a snapshot covers (-1: none), and that snapshot.
STATE = "conv_id bigint, changed bigint, covered bigint, snapshot_version bigint, object_key string, sha256 string, written string"


def arrived(store: Keyed, changes: DataFrame) -> int:
    """Take in changes (conv_id, arrival): a conversation whose last change no snapshot covers is stale."""
    new = changes.groupBy("conv_id").agg(F.max("arrival").alias("_at"))
    none = [F.lit(None).cast("string").alias(c) for c in ("object_key", "sha256", "written")]
    fresh = new.select("conv_id", F.col("_at").alias("changed"), F.lit(-1).cast("long").alias("covered"), F.lit(0).cast("long").alias("snapshot_version"), *none)

    def make(now: DataFrame) -> DataFrame:
        kept = now.join(new, "conv_id", "left").withColumn("changed", F.greatest("changed", "_at")).drop("_at")
        return kept.unionByName(fresh.join(now, "conv_id", "left_anti"))

    return store.change(make, new)


def write_snapshots(store: Keyed, objects: str, build: Callable[[DataFrame], DataFrame], before_commit: Callable[[], object] = lambda: None) -> int:
    """Write the next version of each stale conversation, and mark it. `build` gives conv_id and body for rows (conv_id, changed): a
    document of what had arrived by then.

    Objects come first, in a folder of their own, so that a writer that is overtaken harms nobody's. A mark is set only where the
    version is still the next one, and what it covers is what the document holds: a conversation that has changed since stays stale.
    """
    _, document = store.head()
    stale = store.read(document=document).where("changed > covered")
    written = f"w-{uuid.uuid4().hex}"
    key = F.format_string("snapshots/conversation=%d/v%06d.json", "conv_id", "version")
    next_ = stale.select("conv_id", F.col("changed").alias("_covers"), (F.col("snapshot_version") + 1).alias("version"))
    bodies = next_.join(build(stale.select("conv_id", "changed")), "conv_id").select("conv_id", "_covers", "version", key.alias("key"), "body", F.sha2("body", 256).alias("digest"))
    bodies.write.option("compression", "gzip").json(f"{objects}/{written}")
    made = store.spark.read.schema("conv_id long, _covers long, version long, key string, digest string").json(f"{objects}/{written}")
    before_commit()

    def make(now: DataFrame) -> DataFrame:
        own = now.join(made, "conv_id", "left")
        wins = F.coalesce(F.col("version") == F.col("snapshot_version") + 1, F.lit(False))
        set_ = {"covered": "_covers", "snapshot_version": "version", "object_key": "key", "sha256": "digest"}
        return own.withColumns({c: F.when(wins, F.col(x)).otherwise(F.col(c)) for c, x in set_.items()} | {"written": F.when(wins, F.lit(written)).otherwise(F.col("written"))}).select(*now.columns)

    return store.change(make, made)


def read_back(store: Keyed, objects: str) -> DataFrame:
    """The marked snapshots' rows with their bodies, and whether these are what the marks say."""
    rows = store.read()
    bodies = store.spark.read.schema("key string, body string").json(f"{objects}/w-*").select("key", "body", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("written"))
    own = rows.join(bodies, (rows["object_key"] == bodies["key"]) & (rows["written"] == bodies["written"]), "left").drop(bodies["written"])
    return own.drop("key").withColumn("verified", F.coalesce(F.sha2("body", 256) == F.col("sha256"), F.lit(False)))
