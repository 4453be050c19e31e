"""A conversation's row as a state that merges: of every field, the value that counts, with the time that makes it count.

Captures in any split and order give the same state, and states of parts give that of the whole, so a table of states takes in new
captures by merging their states into the rows of their conversations alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cleaned

#: Completeness from least to most, where only the compliance source may claim the last; longest title and address.
COMPLETENESS = ("unknown", "live_only", "partial_scroll_limit", "complete_current_page", "reconciled", "compliance_verified")
LONGEST = 2048
#: Kinds of sources that a conversation may have.
SOURCES = ("chrome_extension", "compliance", "import")

CAPTURE = "conversation string, at long, title string, url string, model string, user string, completeness string, created long, updated long, source string"
_LAST = "struct<at:bigint,v:string>"
STATE = (
    f"conversation string, title {_LAST}, url {_LAST}, model {_LAST}, updated struct<at:bigint,v:bigint>, user {_LAST}, created struct<at:bigint,v:bigint>, completeness int, first_at bigint, last_at bigint, "
    + "sources struct<"
    + ",".join(f"{s}:bigint" for s in SOURCES)
    + ">"
)


def states(captures: DataFrame) -> DataFrame:
    """Each capture as a state of its own. An empty title, address or model says nothing; created counts on the first capture alone, given or not."""
    said = lambda value, kept=None: F.when(value.isNotNull() & (value.cast("string") != ""), F.struct("at", (value if kept is None else kept).alias("v")))
    own = lambda c: said(F.col(c))
    rank = F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, COMPLETENESS)), F.col("completeness")), F.lit(0)), F.lit(1)).cast("int")
    rank = F.when((rank == len(COMPLETENESS)) & ~F.coalesce(F.col("source") == "compliance", F.lit(False)), 1).otherwise(rank)
    return captures.select(
        "conversation", said(F.col("title"), cleaned(F.col("title"), LONGEST)).alias("title"), said(F.col("url"), F.substring("url", 1, LONGEST)).alias("url"), own("model").alias("model"), own("updated").alias("updated"), own("user").alias("user"),
        F.struct("at", F.col("created").alias("v")).alias("created"), rank.alias("completeness"), F.col("at").alias("first_at"), F.col("at").alias("last_at"),
        F.struct(*(F.when(F.col("source") == s, F.col("at")).alias(s) for s in SOURCES)).alias("sources"),
    )


def merged(*of: DataFrame) -> DataFrame:
    """The states of conversations in all of these tables of states. Times of a conversation's captures differ; of equal ones larger values count."""
    last, first = ("title", "url", "model", "updated", "completeness", "last_at"), ("user", "created", "first_at")
    fold: list[Column] = [F.max(c).alias(c) for c in last] + [F.min(c).alias(c) for c in first]
    fold += [F.struct(*(F.min(f"sources.{s}").alias(s) for s in SOURCES)).alias("sources")]
    return reduce(DataFrame.unionByName, of).groupBy("conversation").agg(*fold).select(*(x.split()[0] for x in _columns()))


def _columns() -> list[str]:
    return ["conversation", "title", "url", "model", "updated", "user", "created", "completeness", "first_at", "last_at", "sources"]


def rows(state: DataFrame) -> DataFrame:
    """States as the archive shows them: plain values, and sources in order of first use."""
    used = F.array_sort(F.filter(F.array(*(F.struct(F.col(f"sources.{s}").alias("at"), F.lit(s).alias("s")) for s in SOURCES)), lambda x: x["at"].isNotNull()))
    return state.select(
        "conversation", *(F.col(f"{c}.v").alias(c) for c in ("title", "url", "model", "updated", "user", "created")), F.element_at(F.array(*map(F.lit, COMPLETENESS)), F.col("completeness")).alias("completeness"),
        "first_at", "last_at", F.array_join(F.transform(used, lambda x: x["s"]), ",").alias("sources"),
    )
