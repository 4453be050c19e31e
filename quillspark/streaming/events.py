"""Event streams: deduplication within lateness, rates by window, and quiet sessions. The same functions serve batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..sources.tables import event_stream, instant

LATENESS = "10 minutes"
#: Rows of a file of the replayed table.
FILE_ROWS = 1_000_000


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir."""
    return shared_dir(spark, "stream")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything the stream has now, as a table: written by its own sink with its own checkpoint, then read back."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def timed(events: DataFrame) -> DataFrame:
    """Event time as an instant, with the lateness the pull's overlapping window allows."""
    return events.withColumn("at", instant(F.col("ts"))).withWatermark("at", LATENESS)


def admitted_once(events: DataFrame) -> DataFrame:
    """The first of each source event id, whichever micro-batch or overlapping window repeats it."""
    return timed(events).dropDuplicatesWithinWatermark(["event_id"])


def minute_rates(events: DataFrame, width: str = "1 hour") -> DataFrame:
    by = timed(events).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.unix_seconds("w.start").alias("start"), "event_type", "n")


def stream_of(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    """The events table as a stream in the order of its times, each row so many times in a micro-batch.

    The table's own files may overlap in time and have any order, and a watermark would drop rows that it overtook. So the
    replay reads a copy in ranges of time, whose files' modification times follow the ranges. Where a store does not keep
    these times, all files are one micro-batch, in which nothing is late."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = f"{scratch(spark)}/events"
    batch.repartitionByRange(max(1, -(-batch.count() // FILE_ROWS)), "ts").sortWithinPartitions("ts").write.parquet(folder)
    files = _in_order(spark, folder)
    streams = [event_stream(spark, folder, batch.schema, *([] if files is None else [files])) for _ in range(times)]
    return reduce(DataFrame.union, streams)


def _in_order(spark: SparkSession, folder: str) -> int | None:
    """Let the files, in the order of their names, have times a second apart; how many they are where that fails."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda: {x.getPath().getName(): x for x in system.listStatus(path) if x.getPath().getName().startswith("part-")}
    found = listed()
    first = min((x.getModificationTime() for x in found.values()), default=0) // 1000 * 1000
    for k, name in enumerate(sorted(found)):
        system.setTimes(found[name].getPath(), first + 1000 * k, -1)
    kept = [x.getModificationTime() for _, x in sorted(listed().items())]
    return None if all(a < b for a, b in zip(kept, kept[1:], strict=False)) else len(kept)
