"""A log of attempts at a stream's batches: a document when one begins and another when it ends, appended to a folder of the shared store.

The log is kept around the batch's own function and not by a listener, which is told of failures late, without their batch, and of a
driver's loss not at all: here an attempt without an end is seen as lost once its batch is begun again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.polling import FAILURES, Folder

ENTRY = "attempt string, query string, batch long, worker string, started_ms long, ended_ms long, succeeded boolean, error_type string, error_summary string, result long"
SUMMARY = 2000


def logged(work: Callable[[DataFrame, int], int | None], log: str, query: str, worker: str = "") -> Callable[[DataFrame, int], None]:
    """`work` for writeStream.foreachBatch, each call of which leaves its attempt in the folder `log`. Work may return a number, its
    result. What it raises is logged by type and the first 2000 characters, and raised again."""
    folder = Folder(log)

    def run(batch: DataFrame, number: int) -> None:
        begun = time.time_ns()
        attempt = f"{begun:020d}-{uuid.uuid4().hex}"  # ids of one millisecond are in order of time
        entry = {"attempt": attempt, "query": query, "batch": number, "worker": worker, "started_ms": begun // 1_000_000}
        folder.write(f"begun-{attempt}.json", entry)
        try:
            outcome = {"succeeded": True, "result": work(batch, number)}
        except Exception as e:
            outcome = {"succeeded": False, "error_type": type(e).__name__, "error_summary": str(e)[:SUMMARY]}
            raise
        finally:
            if "outcome" in locals():  # an interrupt leaves the attempt without an end, as a lost driver does
                folder.write(f"ended-{attempt}.json", entry | outcome | {"ended_ms": time.time_ns() // 1_000_000})

    return run


def attempts(spark: SparkSession, log: str) -> DataFrame:
    """A row for each attempt: query, batch, attempt_number (by time of begin), worker, started_at, duration_ms, outcome (succeeded,
    failed, lost, or running: the last one without an end), error_type, error_summary, result, recovered (the one before was lost)."""
    rows = spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(log)
    once = rows.groupBy("attempt").agg(*(F.max(c).alias(c) for c in ("query", "batch", "worker", "started_ms", "ended_ms", "succeeded", "error_type", "error_summary", "result")))
    by = Window.partitionBy("query", "batch").orderBy("started_ms", "attempt")
    last = F.lead("attempt").over(by).isNull()
    outcome = F.when(F.col("succeeded"), "succeeded").when(~F.col("succeeded"), "failed").when(last, "running").otherwise("lost")
    out = once.withColumns({"attempt_number": F.row_number().over(by), "outcome": outcome, "started_at": F.timestamp_millis("started_ms"), "duration_ms": F.col("ended_ms") - F.col("started_ms")})
    out = out.withColumn("recovered", F.coalesce(F.lag("outcome").over(by) == "lost", F.lit(False)))
    return out.select("query", "batch", "attempt_number", "worker", "started_at", "duration_ms", "outcome", "error_type", "error_summary", "result", "recovered")


def health(log: DataFrame, most: int = FAILURES) -> DataFrame:
    """query, failures (attempts that failed or were lost since the last success), healthy (fewer than `most`), last_error_type."""
    place = F.struct("batch", "attempt_number")
    broken = F.col("outcome").isin("failed", "lost")
    success = log.where("outcome = 'succeeded'").groupBy("query").agg(F.max(place).alias("done"))
    since = log.join(success, "query", "left")
    open_ = broken & (F.col("done").isNull() | (place > F.col("done")))
    out = since.groupBy("query").agg(F.count_if(open_).alias("failures"), F.max_by(F.when(open_, F.col("error_type")), F.when(open_, place)).alias("last_error_type"))
    return out.select("query", "failures", (F.col("failures") < most).alias("healthy"), "last_error_type")


def persevering(writer: Callable[[], DataStreamWriter], most: int = FAILURES) -> int:
    """Start a stream until it ends by itself, at most so many times; how many starts it took. The last failure is raised."""
    for k in range(1, most + 1):
        try:
            writer().start().awaitTermination()
            return k
        except StreamingQueryException:
            if k == most:
                raise
    return most
