"""Admission of requests by several limiters at once: one user's, one user's in a short time, one device's and one address's.

Each limiter counts what it has itself admitted in its window, both ends included, whatever the others say; the strictest answer
stands. Limiters therefore don't meet before their answers do. One limiter's past is forgotten wherever a key is idle for longer
than the window, so a key's requests are cut there, and its pieces are folded in different tasks. Only requests without such a gap
follow each other in one task, which holds no more than the limit's times of admission.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import placed

SECOND = 1_000_000
#: Windows of a slice of time in which a key's gaps are looked for at once.
SLICE = 256


@dataclass(frozen=True)
class Scope:
    """A limiter: the requests' column with its key, its window in microseconds, and what it admits in one."""

    name: str
    column: str
    window: int
    limit: int


def scopes(per_minute: int, burst: int, workers: int = 1, window: int = 60 * SECOND, short: int = SECOND) -> tuple[Scope, ...]:
    """The four limiters of one of `workers` processes that share a budget, strictest first where they agree. Many users share an address."""
    own = max(1, per_minute // max(1, workers))
    return Scope("user", "user", window, own), Scope("burst", "user", short, max(1, burst // max(1, workers))), Scope("device", "device", window, own), Scope("address", "address", window, own * 4)


class Limiter:
    """One key's requests in order of time."""

    def __init__(self, scope: Scope):
        self.scope, self.hits = scope, deque()

    def check(self, now: int, cost: int = 1) -> tuple[bool, int, int]:
        """Whether it is admitted, how many more would be, and after how many seconds to come back."""
        while self.hits and self.hits[0] < now - self.scope.window:
            self.hits.popleft()
        if len(self.hits) + cost > self.scope.limit:
            oldest = self.hits[0] if self.hits else now
            return False, 0, max(1, (self.scope.window - (now - oldest)) // SECOND + 1)
        self.hits.extend([now] * cost)
        return True, self.scope.limit - len(self.hits), 0


def pieces(hits: DataFrame, limiters: tuple[Scope, ...], slice_windows: int = SLICE) -> DataFrame:
    """scope (its place among the limiters), key, piece, request, at, cost: each request once for each limiter that it has a key for. A
    piece starts where its key was idle for longer than the window, and is named by the time it starts at.

    Gaps are found in slices of time; of the slices before it, a row each, a slice learns the last request and the last start. So
    no task sorts all of a key.
    """
    one = [F.when(F.col(s.column) != "", F.struct(F.lit(k).alias("scope"), F.col(s.column).alias("key"), F.lit(s.window).cast("long").alias("window"))) for k, s in enumerate(limiters)]
    rows = hits.select("request", "at", "cost", F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("x")).select("request", "at", "cost", "x.*")
    rows = rows.withColumn("slice", F.floor(F.col("at") / (F.col("window") * slice_windows)))
    inside = Window.partitionBy("scope", "key", "slice").orderBy("at", "request")
    earlier = Window.partitionBy("scope", "key").orderBy("slice")
    gap = lambda at, before: before.isNull() | (at - before > F.col("window"))
    rows = rows.withColumn("before", F.lag("at").over(inside))
    # Of a slice: its ends, and the last start in it that its own rows prove.
    ends = rows.groupBy("scope", "key", "slice").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max(F.when(F.col("before").isNotNull() & (F.col("at") - F.col("before") > F.col("window")), F.col("at"))).alias("start"), F.first("window").alias("window"))
    ends = ends.withColumn("opens", gap(F.col("first"), F.lag("last").over(earlier)))
    ends = ends.withColumn("start", F.coalesce("start", F.when(F.col("opens"), F.col("first"))))
    ends = ends.withColumn("since", F.when(F.col("opens"), F.col("first")).otherwise(F.last("start", True).over(earlier.rowsBetween(Window.unboundedPreceding, -1))))
    own = rows.join(ends.select("scope", "key", "slice", "since"), ["scope", "key", "slice"])
    started = F.max(F.when(F.col("before").isNotNull() & (F.col("at") - F.col("before") > F.col("window")), F.col("at"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("piece", F.coalesce(started, F.col("since"))).select("scope", "key", "piece", "request", "at", "cost")


def answers(hits: DataFrame, limiters: tuple[Scope, ...], slice_windows: int = SLICE) -> DataFrame:
    """request, scope, allowed, remaining, retry_after: each limiter's answer to each request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, limiter = None, None
        for b in batches:
            out = []
            for scope, key, piece, at, cost in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4, 5)), strict=True):
                if (scope, key, piece) != now:
                    now, limiter = (scope, key, piece), Limiter(limiters[scope])
                out.append(limiter.check(at, cost))
            allowed, remaining, after = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(0), pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int64()), pa.array(after, pa.int64())], ["request", "scope", "allowed", "remaining", "retry_after"])

    by = ["scope", "key", "piece"]
    ordered = pieces(hits, limiters, slice_windows).repartition(*by).sortWithinPartitions(*by, "at", "request")
    return ordered.mapInArrow(run, "request long, scope int, allowed boolean, remaining long, retry_after long")


def decisions(hits: DataFrame, limiters: tuple[Scope, ...], slice_windows: int = SLICE) -> DataFrame:
    """request, allowed, remaining, retry_after, scope, limit: the strictest answer to each of hits (request, at in microseconds, cost, and
    the limiters' columns of keys, as text). Of answers as strict, the first limiter's; without a key a request is allowed, with nulls.

    request is unique and at isn't null. A null or empty key takes no part.
    """
    strictness = F.struct("allowed", F.when(F.col("allowed"), F.col("remaining")).otherwise(-F.col("retry_after")).alias("x"), "scope")
    worst = answers(hits, limiters, slice_windows).groupBy("request").agg(F.min_by(F.struct("allowed", "remaining", "retry_after", "scope"), strictness).alias("x"))
    named = lambda pick: reduce(lambda c, k: c.when(F.col("x.scope") == k, pick(limiters[k])), range(1, len(limiters)), F.when(F.col("x.scope") == 0, pick(limiters[0])))
    all_ = hits.select("request").join(worst, "request", "left")
    return all_.select("request", F.coalesce("x.allowed", F.lit(True)).alias("allowed"), "x.remaining", "x.retry_after", named(lambda s: F.lit(s.name)).alias("scope"), named(lambda s: F.lit(s.limit).cast("long")).alias("limit"))


#: Keys that a limiter's state may hold, and slices of its window in which they are counted when it holds more.
MOST_KEYS, SLICES = 100_000, 4096


def pruned(state: DataFrame, now: int, window: int, most: int = MOST_KEYS, slices: int = SLICES) -> DataFrame:
    """Rows of state (key, last: the time of its last request in microseconds) that are kept: none that is idle for longer than the
    window, and, where more than `most` are left, not the colder half of them (rounded down). Of equal times smaller keys are colder.

    Counts by slices of the window tell in which slice the half ends; only that slice's rows are put in order. A last that is null
    is idle; a key occurs once.
    """
    live = state.where(F.col("last") >= now - window).withColumn("_slice", F.least(F.floor((F.col("last") - (now - window)) * slices / (window + 1)), F.lit(slices)).cast("int"))
    counts = sorted(tuple(r) for r in live.groupBy("_slice").agg(F.count("*").alias("n")).collect())  # a row a slice
    total = sum(n for _, n in counts)
    if total <= most:
        return live.drop("_slice")
    gone, at, before = total // 2, None, 0
    for at, n in counts:
        if before + n > gone:
            break
        before += n
    warmer = live.where(F.col("_slice") > at).drop("_slice")
    edge = placed(live.where(F.col("_slice") == at), "last", "key", name="_place")
    return warmer.unionByName(edge.where(F.col("_place") >= gone - before).drop("_place", "_slice"))
