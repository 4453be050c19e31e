"""Operator 2: exact top-k inner products by a three-phase uniform threshold.

A vector's score is the sum of the scores of a few blocks of its components. Phase 1 gathers, from every partition and for
every block, the entries that lead that block's local list, with their whole scores: the k-th best of these is a safe cutoff.
Phase 2 hands out the cutoff; a vector that reaches it must reach an even share of it in some block, so only such entries
are collected, and of those only the ones that could still reach it. Phase 3 adds the remaining scores of these exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 10
SCALE = 1024
#: Blocks of components, each with lists of its own.
LISTS = 4
#: Queries that are handed to all tasks at a time, and rows and queries that a task multiplies at a time.
BLOCK, ROWS, TILE = 8192, 2048, 512


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component. Vectors that are null or empty or hold null or non-finite components are left out."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    usable = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where((F.size("embedding") > 0) & finite)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


class _Queries:
    """A block of queries of one length, with the cutoffs known so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, cutoff: np.ndarray):
        self.ids, self.matrix, self.cutoff = ids, matrix, cutoff


def _chunks(batches: Iterator[pa.RecordBatch], lengths: set[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most ROWS vectors of one of these lengths at a time."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            b = whole.slice(i, ROWS)
            ids, column = b.column(0).to_numpy(), b.column(1)
            sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for n in lengths & {*sizes.tolist()}:
                rows = np.flatnonzero(sizes == n)
                yield ids[rows], flat[starts[rows][:, None] + np.arange(n)]


def _product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, queries by rows; in floating point where that is exact."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2**53:
        return q.astype(np.float64) @ x.T.astype(np.float64)
    return q.astype(object) @ x.T.astype(object)


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their query, ties to smaller ids."""
    order = np.lexsort((ids, -scores, q))
    first = np.flatnonzero(np.r_[True, np.diff(q[order]) > 0])
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[place < k]


def _leaders(x: np.ndarray, ids: np.ndarray, q: _Queries, tile: slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: (query, row, score) of the entries that lead some block's list."""
    n, own = len(ids), q.ids[tile, None] == ids[None, :]
    parts = [_product(x[:, c], q.matrix[tile][:, c]).astype(np.float64) for c in np.array_split(np.arange(x.shape[1]), LISTS) if len(c)]
    listed = np.zeros(own.shape, bool)
    for s in parts:
        s = np.where(own, -np.inf, s)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), s.shape)
        np.put_along_axis(listed, top, True, axis=1)
    qi, xi = np.nonzero(listed & ~own)
    return qi + tile.start, xi, _exact(x, q, qi + tile.start, xi)


def _sufficient(x: np.ndarray, ids: np.ndarray, q: _Queries, tile: slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query, row, score) of all entries that reach the query's cutoff."""
    cut = q.cutoff[tile, None]
    parts = [_product(x[:, c], q.matrix[tile][:, c]) for c in np.array_split(np.arange(x.shape[1]), LISTS) if len(c)]
    share = cut / len(parts)
    share = share - 1e-12 * np.abs(share, where=np.isfinite(share), out=np.zeros_like(share)) - 1e-6  # a little lower than rounding could make it is safe
    reaches = reduce(np.logical_or, (s >= share for s in parts))
    most = sum(np.maximum(s.astype(np.float64), np.where(np.isinf(share), s.astype(np.float64), share)) for s in parts)
    qi, xi = np.nonzero(reaches & (most >= len(parts) * share - 1e-3) & (q.ids[tile, None] != ids[None, :]))
    scores = _exact(x, q, qi + tile.start, xi)
    enough = scores >= q.cutoff[qi + tile.start]
    return qi[enough] + tile.start, xi[enough], scores[enough]


def _exact(x: np.ndarray, q: _Queries, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Whole scores of single entries, in integers."""
    out = np.empty(len(qi), np.int64)
    for i in range(0, len(qi), 1 << 16):
        out[i : i + (1 << 16)] = np.einsum("ij,ij->i", x[xi[i : i + (1 << 16)]], q.matrix[qi[i : i + (1 << 16)]])
    return out


def _lower(cutoff: float) -> float:
    """cutoff, or the next number below where floating point may not hold it."""
    return cutoff if abs(cutoff) < 2**53 or cutoff == -np.inf else float(np.nextafter(float(cutoff), -np.inf))


def _pass(candidates: DataFrame, queries: dict[int, _Queries], phase, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best entries of every query that `phase` finds in each partition."""
    given = candidates.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}
        queries = given.value
        for ids, x in _chunks(batches, {*queries}):
            q = queries[x.shape[1]]
            for at in range(0, len(q.ids), TILE):
                qi, xi, scores = phase(x, ids, q, slice(at, min(at + TILE, len(q.ids))), k)
                old = held.get((x.shape[1], at))
                found = (qi, ids[xi], scores) if old is None else tuple(np.r_[a, b] for a, b in zip(old, (qi, ids[xi], scores), strict=True))
                best = _best(*found, k)
                held[x.shape[1], at] = tuple(a[best] for a in found)
        for (n, _), (qi, vec, scores) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(queries[n].ids[qi]), pa.array(vec), pa.array(scores)], ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 100, k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row whose vec_id is divisible by `every`,
    against all rows with another vec_id; all, if fewer. Ties go to smaller vec_ids.

    Vectors that are null, empty or not finite, and null ids, take no part; a query meets vectors of its own length. Repeated
    rows are candidates each; of repeated query ids one row asks (the smallest vector). Vectors may be of any length: a task
    multiplies 2048 at a time. Empty table: no rows.
    """
    candidates = stored(quantised(vectors, scale))
    asked = candidates.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stored(asked)
    blocks = max(1, -(-asked.count() // block))
    results = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # about `block` rows
        queries = {}
        for n in {len(r.v) for r in rows}:
            own = sorted((r.vec_id, r.v) for r in rows if len(r.v) == n)
            queries[n] = _Queries(np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.int64), np.full(len(own), -np.inf))
        last = _ranked(_pass(candidates, queries, _leaders, k), k).where(F.col("rank") == k)
        cutoffs = {r.query_id: r.score for r in last.select("query_id", "score").collect()}  # one row a query
        for q in queries.values():
            q.cutoff = np.array([_lower(cutoffs.get(i, -np.inf)) for i in q.ids.tolist()], np.float64)
        found = _ranked(_pass(candidates, queries, _sufficient, k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        results.append(stored(found) if blocks > 1 else found)
    return reduce(DataFrame.unionByName, results)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""
