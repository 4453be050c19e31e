"""Pulled pages of upstream events and files by reference."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import parsed_time

#: Seconds that a pull reaches back before its window, so that late events are met again and dropped by their key.
OVERLAP = 600

PAGE = "cursor string, items array<struct<id:string,type:string,created_at:string,conversation_id:string,actor:string,raw:string>>"


def page_events(pages: DataFrame) -> DataFrame:
    """Events of pages, one row each: kind by ordered rules, a deletion flag, time or null. Items without an id are dropped."""
    x = pages.select(F.explode("items").alias("x")).select("x.*").where("id is not null and id <> ''")
    kind = F.lower(F.coalesce("type", F.lit("")))
    name = F.when(kind.contains("delet") | kind.contains("purge"), "deletion").when(kind.contains("message"), "message").when(kind.contains("conversation"), "conversation").otherwise("other")
    return x.select(F.col("id").alias("source_event_id"), name.alias("kind"), kind.contains("delet").alias("is_deletion"), parsed_time(F.col("created_at")).alias("event_time"), "conversation_id", "actor", "raw")


def pulled(spark: SparkSession, folder: str, since: str, until: str, known: DataFrame | None = None) -> DataFrame:
    """Events of a folder of JSON pages in [since - overlap, until], each id once and only if not known. Times are UTC."""
    events = page_events(spark.read.schema(PAGE).json(folder))
    begin = F.to_timestamp(F.lit(since)) - F.expr(f"interval {OVERLAP} seconds")
    inside = events.where((F.col("event_time") >= begin) & (F.col("event_time") <= F.to_timestamp(F.lit(until))))
    first = inside.groupBy("source_event_id").agg(F.min_by(F.struct("kind", "is_deletion", "event_time", "conversation_id", "actor", "raw"), "event_time").alias("x")).select("source_event_id", "x.*")
    return first if known is None else first.join(known, "source_event_id", "left_anti")


def page_stream(spark: SparkSession, folder: str, most_pages: int = 50) -> DataFrame:
    """The same pages as a stream, at most most_pages a micro-batch, each event id once within the overlap."""
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", most_pages).json(folder)
    return page_events(pages).withWatermark("event_time", f"{OVERLAP} seconds").dropDuplicatesWithinWatermark(["source_event_id"])


def files(spark: SparkSession, folder: str, most_bytes: int) -> DataFrame:
    """Files of at most most_bytes; the limit is a filter on metadata, so larger ones are never read."""
    return spark.read.format("binaryFile").load(folder).where(F.col("length") <= most_bytes)


def bounded(spark: SparkSession, folder: str, most_bytes: int) -> DataFrame:
    """path, length, data, bytes_read, too_large of all files of a folder, a file a row. Of each at most one byte beyond the limit is read,
    which tells that it is larger than that even where its listed length is wrong; a larger file's data is null; an empty file has no row, as Spark lists none. The folder must be in a
    store that pyarrow can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, length in zip(b["path"].to_pylist(), b["length"].to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
                with system.open_input_file(name) as f:
                    data = f.read_at(most_bytes + 1, 0)
                large = len(data) > most_bytes
                rows = [pa.array([path]), pa.array([length]), pa.array([None if large else data], pa.binary()), pa.array([len(data)], pa.int64()), pa.array([large])]
                yield pa.RecordBatch.from_arrays(rows, ["path", "length", "data", "bytes_read", "too_large"])

    listed = heads(spark, folder).select("path", "length")
    return listed.mapInArrow(run, "path string, length long, data binary, bytes_read long, too_large boolean")


def heads(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and time of files, without their content."""
    return spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
