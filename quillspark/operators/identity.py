"""Message identity, versions and pointers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .capture import hashed


def by_content(log: DataFrame) -> DataFrame:
    """Messages where no capture has a source id: then identity is (conversation, role, normalised content)."""
    return hashed(log).groupBy("conv_id", "role", "digest").agg(F.min("arrival").alias("first_arrival"), F.count("*").alias("captures"), F.max_by("seq", "arrival").alias("seq"))


#: A capture with the message and the version that it belongs to, by which layer, and what it did: new, identical or reconciled.
RESOLVED = "conv_id long, message long, layer string, version_number int, outcome string, role string, source_id string, seq long, status string, arrival long, digest string"


class _Conversation:
    """Captures of one conversation in order of arrival: by source id, then fingerprint, then role and content of any version, of
    which the smallest place, then the message that came first, counts. It holds its messages and the digests of their contents,
    not its captures."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.by_source: dict[str, dict] = {}
        self.by_print: dict[str, dict] = {}
        self.by_content: dict[tuple[str, str], list[dict]] = {}

    def add(self, role, source_id, seq, status, arrival, digest, fingerprint) -> tuple:
        source, layer = source_id or None, "source"
        known = self.by_source.get(source) if source else None
        if known is None:
            known, layer = self.by_print.get(fingerprint), "fingerprint"
        if known is None and (same := self.by_content.get((role, digest))):
            known, layer = min(same, key=lambda m: (m["seq"] is None, m["seq"] or 0, m["message"])), "content"
        if known is None:
            known, layer = {"message": arrival, "role": role, "source": None, "contents": {}}, "none"
            self.by_print[fingerprint] = known
        if not known["source"] and source:
            known["source"] = source
            self.by_source[source] = known
        known["seq"] = seq
        had = known["contents"].get(digest)
        if had is None:
            version, outcome = len(known["contents"]) + 1, "new"
            known["contents"][digest] = [version, status]
            self.by_content.setdefault((known["role"], digest), []).append(known)
        else:
            version, outcome = had[0], "reconciled" if had[1] == "partial" and status == "complete" else "identical"
            if outcome == "reconciled":
                had[1] = "reconciled"
        return self.conv_id, known["message"], layer, version, outcome, known["role"], source, seq, status, arrival, digest


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation and arrival, a batch at a time; one conversation's messages are all that is held."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RESOLVED.split(", "))])
    now = None
    for b in batches:
        out = []
        for conv_id, *capture in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or conv_id != now.conv_id:
                now = _Conversation(conv_id)
            out.append(now.add(*capture))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def resolved(fingerprinted: DataFrame) -> DataFrame:
    """Every capture with its message. Order decides identity, so each conversation is folded by itself, as Spark's sort gives its captures."""
    columns = [F.col(c).cast("long").alias(c) if c in ("conv_id", "seq", "arrival") else c for c in ("conv_id", "role", "source_id", "seq", "status", "arrival", "digest", "fingerprint")]
    return fingerprinted.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "arrival").mapInArrow(_folded, RESOLVED)


def messages(captures: DataFrame) -> DataFrame:
    """One row a message of resolved captures: its first source id, last place, versions, pointer to the version last newly inserted,
    latest version that is complete (0: none), and its state, which stays complete once it was."""
    new, again = F.col("outcome") == "new", F.col("outcome") == "reconciled"
    whole = (new & (F.col("status") == "complete")) | again
    state = F.when(F.bool_or(whole), "complete").otherwise(F.max_by("status", F.when(new, F.col("arrival"))))
    return captures.groupBy("conv_id", "message").agg(
        F.first("role").alias("role"),
        F.min_by("source_id", F.when(F.col("source_id").isNotNull(), F.col("arrival"))).alias("source_id"),
        F.max_by("seq", "arrival").alias("seq"),
        F.max("version_number").alias("versions"),
        F.max_by("digest", F.when(new, F.col("version_number"))).alias("current_digest"),
        F.coalesce(F.max(F.when(whole, F.col("version_number"))), F.lit(0)).alias("latest_complete"),
        state.alias("status"),
        F.count("*").cast("int").alias("captures"),
        F.count_if(F.col("outcome") == "identical").cast("int").alias("identical"),
        F.count_if(again).cast("int").alias("reconciled"),
    )


def three_layer(admitted: DataFrame, fingerprinted: DataFrame) -> DataFrame:
    """One row a message, with how many captures it took and what they did."""
    return messages(resolved(fingerprinted)).drop("current_digest", "latest_complete")


def message_versions(captures: DataFrame) -> DataFrame:
    """Versions of the messages that identity resolves: one aggregate by (message, version), then the newest complete one beside it.

    A version is what first brought its content; partial content that came again complete is reconciled, and a partial version
    that did not is superseded by the newest complete one of its message (0: none)."""
    again = F.bool_or(F.col("outcome") == "reconciled")
    each = captures.groupBy("conv_id", "message", "version_number").agg(
        F.first("role").alias("role"), F.first("digest").alias("digest"), F.min("arrival").alias("first_arrival"), F.count("*").alias("captures"),
        F.when(again, "reconciled").otherwise(F.min_by("status", "arrival")).alias("version_status"),
    )
    newest = F.max(F.when(F.col("version_status").isin("complete", "reconciled"), F.col("version_number"))).over(Window.partitionBy("conv_id", "message"))
    later = F.col("version_number") > 1
    return each.select(
        "*", (later & (F.col("role") == "user")).alias("is_edit"), (later & (F.col("role") == "assistant")).alias("is_regeneration"),
        F.coalesce(F.when(F.col("version_status") == "partial", newest), F.lit(0)).alias("superseded_by"),
    )


def contents(admitted: DataFrame) -> DataFrame:
    """Distinct contents of each (conversation, turn), with what arrived first and whether one was complete."""
    return (
        hashed(admitted)
        .groupBy("conv_id", "turn", "role", "digest")
        .agg(
            F.min("arrival").alias("first_arrival"),
            F.max("arrival").alias("last_arrival"),
            F.min_by("status", "arrival").alias("first_status"),
            F.bool_or(F.col("status") == "complete").alias("completed"),
            F.min_by("text", "arrival").alias("text"),
            F.min_by("seq", "arrival").alias("seq"),
        )
    )


def versions(admitted: DataFrame) -> DataFrame:
    """Contents numbered by first arrival within their message."""
    by = Window.partitionBy("conv_id", "turn").orderBy("first_arrival")
    return contents(admitted).withColumn("version_number", F.row_number().over(by))


def current(numbered: DataFrame) -> DataFrame:
    """Per message the version last newly inserted, and the latest complete one; no sort, both are aggregates."""
    return numbered.groupBy("conv_id", "turn", "role").agg(
        F.max("version_number").alias("version_count"),
        F.max_by("digest", "version_number").alias("current_digest"),
        F.coalesce(F.max(F.when(F.col("completed"), F.col("version_number"))), F.lit(0)).alias("latest_complete"),
    )
