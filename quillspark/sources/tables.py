"""Readers. Times without a zone are read as UTC instants, which event time in streams needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(column: str | Column) -> Column:
    """A time without a zone as the instant it has in UTC, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), column).cast("timestamp")


def epoch(column: str | Column) -> Column:
    """Whole seconds since 1970 of a time without a zone."""
    return F.unix_seconds(instant(column))


def event_stream(spark: SparkSession, folder: str, schema, max_files: int = 8) -> DataFrame:
    """A stream over a folder of Parquet files that grows; at most max_files of them a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
