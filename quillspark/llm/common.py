"""What the operators share: reading tables, the shared folder, materialised intermediates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, shared_dir, stored

__all__ = ["discard", "joined_runs", "shared_dir", "stored", "table", "texts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) of any table of documents; other columns are left behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def joined_runs(spans: str, start: str = "start", end: str = "end") -> str:
    """SQL for array<struct<start, end>>: an array of spans with overlapping and touching ones joined, in proportion to their number.

    With starts and ends each in order, a run ends exactly where the next start lies behind the end of the same place.
    """
    first = "filter(z.s, (x, i) -> case when i = 0 then true else x > z.e[i - 1] end)"
    last = "filter(z.e, (x, i) -> case when i = size(z.e) - 1 then true else z.s[i + 1] > x end)"
    sides = f"struct(array_sort(transform({spans}, x -> x.{start})) as s, array_sort(transform({spans}, x -> x.{end})) as e)"
    both = f"transform(array(struct({first} as s, {last} as e)), y -> transform(y.s, (x, i) -> struct(x as start, y.e[i] as end)))[0]"
    return f"transform(array({sides}), z -> {both})[0]"
