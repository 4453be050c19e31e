"""Row numbers without one task for all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def placed(df: DataFrame, *by: str | Column, name: str = "place") -> DataFrame:
    """df as a stored table with each row's place, from 0, in the order of all its rows by the columns `by`; rows equal in these
    have some order.

    Ranges of the order, as many as shuffle partitions, are sorted on their own, whatever distances the values have. The
    ranges' counts, a row each, are summed up before them.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the range's number above the row's number in it
    rows = stored(df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_at", at))
    rows = rows.select("*", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(2**33 - 1).alias("_row")).drop("_at")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_row")).drop("_range", "_row", "_start")


def numbered(df: DataFrame, group: str, by: str, name: str = "number") -> DataFrame:
    """df with each row's place, from 0, in its group by ascending `by`: its place among all rows by group and `by` less the group's first."""
    rows = placed(df, group, by, name="_place")
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    return rows.join(first, rows[group].eqNullSafe(first["_group"])).withColumn(name, F.col("_place") - F.col("_first")).drop("_group", "_place", "_first")
