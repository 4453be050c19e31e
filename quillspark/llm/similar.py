"""The pipeline's near-duplicates: texts whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.

SimHash fingerprints at most four bits apart propose pairs, by operator 10's join; an exact check follows, so that only links whose
similarity was computed from the whole sets count. At similarity 0.8 two fingerprints differ in about ten bits, which no such
join reaches: for these, bands of minimal hashes propose too. Components of all proposals bound what is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts
from .components import components
from .simhash import DISTANCE, fingerprint, first_of_each, near_pairs, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Bands, and minimal hashes in each: a pair at similarity s shares a band with chance 1 - (1 - s ** ROWS) ** BANDS.
BANDS, ROWS = 36, 7
#: Texts of one component of proposals that a task compares at a time.
BLOCK = 2048

_RANDOM = np.random.default_rng(17)
_FLIP = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def distinct(hashes: list[int]) -> np.ndarray:
    """A text's distinct shingles, sorted; one without words has the one shingle 0."""
    return np.unique(np.array(hashes or [0], np.uint64))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    return distinct(shingle_hashes(text, size))


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band."""
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 512):
        x = (own[i : i + 512, None] ^ _FLIP) * _TIMES
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND
    return keys ^ (keys >> np.uint64(29))


def banded(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, t (a hash of the text), fp (the fingerprint, as operator 10 makes it of shingles), keys of the bands, of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys = [], []
            for text in b.column(1).to_pylist():
                hashes = shingle_hashes(text, size)
                fps.append(fingerprint(hashes))
                keys.append(bands(distinct(hashes)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "t", "fp", "keys"])

    return texts(docs).withColumn("t", F.xxhash64("text")).mapInArrow(run, "doc_id long, t long, fp long, keys array<long>")


def near(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) by fingerprint: from the least text of each to its others, and between the least of fingerprints that are near."""
    each = marked.dropDuplicates(["t"]).select("fp", "t")
    least = stored(each.groupBy("fp").agg(F.min("t").alias("low")))
    same = each.join(least, "fp").where("t <> low").select(F.col("low").alias("a"), F.col("t").alias("b"))
    first, second = (least.select(F.col("fp").alias(f), F.col("low").alias(c)) for f, c in (("f", "a"), ("g", "b")))
    pairs = near_pairs(least, distance).select(F.col("a").alias("f"), F.col("b").alias("g"))
    return pairs.join(first, "f").join(second, "g").select("a", "b").unionByName(same)


def proposed(marked: DataFrame) -> DataFrame:
    """Links (a, b) by fingerprints and by bands."""
    return near(marked).unionByName(banded_alike(marked)).distinct()


def banded_alike(marked: DataFrame) -> DataFrame:
    """Links (a, b) from the least text of each band's bucket to the others in it: as many as rows, whatever a bucket holds."""
    keyed = marked.dropDuplicates(["t"]).select("t", F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low < high").select("key", "low"))
    return keyed.join(shared, "key").where("t <> low").select(F.col("low").alias("a"), F.col("t").alias("b")).distinct()


def similar_links(sets: list[np.ndarray], least: float = SIMILARITY) -> Iterator[tuple[int, np.ndarray]]:
    """Links (one, others) that connect what is similar among these sets: trees, not all pairs."""
    sizes = np.array([len(s) for s in sets])
    _, every = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    waiting = np.arange(len(sets))
    here = np.zeros(int(every.max()) + 1, np.int32)

    def members(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.r_[0, np.cumsum(sizes[which])[:-1]]
        return every[np.arange(int(sizes[which].sum())) + np.repeat(starts[which] - first, sizes[which])], first

    while len(waiting) > 1:
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            now, front = front[0], front[1:]
            n = sizes[now]
            fits = np.flatnonzero((sizes[waiting] >= least * n) & (n >= least * sizes[waiting]))
            if not len(fits):
                continue
            own = every[starts[now] : starts[now] + n]
            here[own] = 1
            found, first = members(waiting[fits])
            both = np.add.reduceat(here[found], first)
            here[own] = 0
            near = fits[both >= least * (n + sizes[waiting[fits]] - both)]
            if len(near):
                got = waiting[near]
                yield int(now), got
                front, waiting = np.r_[front, got], np.delete(waiting, near)


def _compare(batches: Iterator[pa.RecordBatch], size: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (part, root, t, text) sorted by part and root; yields links (a, b) inside each such group."""

    def links(ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = np.array(ids, np.int64)
        for one, others in similar_links(sets, least) if len(ids) > 1 else ():
            a = np.full(len(others), at[one])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, at[others])), pa.array(np.maximum(a, at[others]))], ["a", "b"])

    group, ids, sets = None, [], []
    for b in batches:
        for i in range(0, b.num_rows, 256):
            for part, root, t, text in zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True):
                if (part, root) != group:
                    yield from links(ids, sets)
                    group, ids, sets = (part, root), [], []
                ids.append(t)
                sets.append(shingles(text, size))
    yield from links(ids, sets)


def verified(docs: DataFrame, links: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of texts at least that similar that make the same components as all such pairs inside each component of the given links.

    A component of more than `block` texts is cut into numbered blocks, and every pair of its blocks is compared on its own.
    """
    found = stored(components(links).select(F.col("node").alias("t"), "root"))
    many = found.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("t", F.lit(1)), F.col("blocks")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, own).cast("long") * F.col("blocks") + F.greatest(x, own))
    dealt = found.join(many, "root").select("t", "root", F.explode(parts).alias("part"))
    whole = texts(docs).select(F.xxhash64("text").alias("t"), "text").join(found.select("t"), "t", "left_semi").dropDuplicates(["t"])
    ordered = dealt.join(whole, "t").select("part", "root", "t", "text").repartition("part", "root").sortWithinPartitions("part", "root", "t")
    return ordered.mapInArrow(lambda batches: _compare(batches, size, least), "a long, b long").distinct()


def one_of_similar(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, with one row of each component of similar texts: of its smallest doc_id (null only where all are).

    Null, empty and white texts are alike. Of repeated rows one stays. Texts are compared whole, however long; columns may have
    any names. Empty table: no rows.
    """
    marked = stored(banded(docs, size))
    links = verified(docs, proposed(marked), size, least, block)
    return first_of_each(docs, marked.select("doc_id", "t", F.col("t").alias("fp")), links)
