"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(lowest, "a").where(F.col("b") > F.col("a")).select(F.col("low").alias("a"), "b").where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these. Links are (smaller a, larger b)."""
    lowest = links.groupBy("b").agg(F.min("a").alias("low"))
    moved = links.join(lowest, "b").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.where("a <> b").unionByName(lowest.select(F.col("low").alias("a"), "b")).distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component, for the root itself too.

    Each round is written to the shared folder; rounds end when every node hangs on its root, in about log(longest path)
    rounds. No node's neighbours ever meet in one row or task other than through aggregates and joins.
    """
    now = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(most_rounds):
        # Stars only: nobody is both a centre and a leaf, and each leaf has one centre.
        leaves = now.select(F.col("b").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre"))
        centres = now.select(F.col("a").alias("node")).distinct().select("node", F.lit(0).alias("leaf"), F.lit(1).alias("centre"))
        state = leaves.unionByName(centres).groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("centre").alias("centre"))
        if state.where("leaf > 1 or (leaf > 0 and centre > 0)").isEmpty():
            break
        after = stored(_small_star(_large_star(now)))
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
