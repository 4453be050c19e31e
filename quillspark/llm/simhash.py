"""Operator 10: SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most four bits differ in at most one bit of some third of them. Each third is indexed
once for every bit as a wildcard, so that an equality join finds all such pairs, which are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts
from .components import components

SHINGLE = 4
#: Bits that may differ.
DISTANCE = 4
SEED = 42
#: First bit and number of bits of each segment: the fewest of which one always differs in at most one bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one signature that a task compares at a time.
BLOCK = 4096
#: Blocks of one signature beyond which its fingerprints are split by what else they share before blocks are compared.
SPLIT = 4
#: Signatures in a broadcast table, of two numbers each; more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of `size` words (repeats included), or of all words where there are fewer; [] without words."""
    import xxhash

    words = text.encode().translate(LOWER).split()  # bytes split at exactly \\x20 and \\x09-\\x0D
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-size]].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 without any."""
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    every = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(every), 1 << 14):
        ones += np.unpackbits(every[i : i + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, t (a hash of the text), fp (the fingerprint as a signed long) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t, size)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], ["doc_id", "t", "fp"])

    return texts(docs).withColumn("t", F.xxhash64("text")).mapInArrow(run, "doc_id long, t long, fp long")


#: By bit: the first bit and the mask of its segment.
LOW = np.repeat(np.array([a for a, _ in SEGMENTS]), [n for _, n in SEGMENTS])
MASK = np.repeat(np.array([((1 << n) - 1) << a for a, n in SEGMENTS], np.uint64), [n for _, n in SEGMENTS])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signatures(fps: DataFrame) -> DataFrame:
    """For each fp and each bit of each segment: the segment without that bit, hashed, as key. 64 rows a fingerprint."""
    rows = [F.struct(F.lit(bit).alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed(int(MASK[bit]) & ~(1 << bit)))).alias("part")) for bit in range(64)]
    return fps.select("*", F.explode(F.array(*rows)).alias("v")).select(*fps.columns, F.xxhash64("v.bit", "v.part").alias("key"), F.col("v.bit").alias("bit"))


def large_signatures(fps: DataFrame, block: int) -> DataFrame:
    """key, blocks of signatures that over `block` fingerprints may share: those of segments that over half as many have."""
    parts = [F.struct(F.lit(a).alias("low"), F.col("fp").bitwiseAND(F.lit(_signed(int(MASK[a])))).alias("part")) for a, _ in SEGMENTS]
    heavy = fps.select(F.explode(F.array(*parts)).alias("v")).groupBy("v.low", "v.part").count().where(F.col("count") > block // 2)
    own = signatures(heavy.select(F.col("part").alias("fp"), "low", "count"))
    inside = F.array(*[F.lit(int(x)) for x in LOW])[F.col("bit")] == F.col("low")
    return own.where(inside).groupBy("key").agg((F.ceil(2 * F.max("count") / block) + 1).cast("int").alias("blocks"))


def _verified(a, b: np.ndarray, bit, distance: int) -> np.ndarray:
    """Are these pairs near, and is this the signature to report them by? A pair whose segments are equal meets by each of
    its wildcards, one whose segments differ in one bit by that alone; only the first of these counts."""
    differs = a ^ b
    inside = differs & MASK[bit]
    return (np.bitwise_count(differs) <= distance) & ((inside == np.left_shift(np.uint64(1), np.asarray(bit).astype(np.uint64))) | ((inside == 0) & (bit == LOW[bit])))


def _joined_block(fp: np.ndarray, bit: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is near among the fingerprints of one signature: a tree, not all pairs."""
    waiting = np.arange(len(fp))
    while len(waiting) > 1:
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            now, front = front[0], front[1:]
            near = _verified(fp[now], fp[waiting], bit, distance)
            got = waiting[near]
            if len(got):
                yield np.full(len(got), fp[now]), fp[got]
                front, waiting = np.r_[front, got], waiting[~near]


def _compare(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, bit, fp) sorted by key; yields (a, b) of near fingerprints with one key."""
    held = None

    def near(key: np.ndarray, bit: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat(sizes <= 32, sizes)
        for step in range(1, min(32, int(sizes.max(initial=0)))):
            at = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
            at = at[_verified(fp[at], fp[at + step], bit[at], distance)]
            if len(at):
                yield fp[at], fp[at + step]
        for k in np.flatnonzero(sizes > 32):
            yield from _joined_block(fp[starts[k] : starts[k] + sizes[k]], int(bit[starts[k]]), distance)

    def out(parts) -> Iterator[pa.RecordBatch]:
        for a, b in parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a.view(np.int64), b.view(np.int64))), pa.array(np.maximum(a.view(np.int64), b.view(np.int64)))], ["a", "b"])

    for batch in batches:
        now = [batch.column("key").to_numpy(), batch.column("bit").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)]
        if held is not None:
            now = [np.r_[x, y] for x, y in zip(held, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last key may go on
        yield from out(near(*(x[:cut] for x in now)))
        held = [x[cut:] for x in now]
    if held is not None:
        yield from out(near(*held))


def finer_signatures(keyed: DataFrame, distance: int) -> DataFrame:
    """Rows (fp, bit, key) under the key and each of distance + 1 parts of the bits outside the key's segment: of two fingerprints at
    most `distance` bits apart, one such part is equal. At four bits, five rows of eight or nine more bits each."""
    parts = {low: np.array_split(np.flatnonzero(LOW != low), distance + 1) for low in {int(x) for x in LOW}}
    masks = F.array(*[F.array(*[F.lit(_signed(sum(1 << int(x) for x in part))) for part in parts[int(low)]]) for low in LOW])
    keys = F.transform(masks[F.col("bit")], lambda m, k: F.xxhash64("key", k, F.col("fp").bitwiseAND(m)))
    return keyed.select("fp", "bit", F.explode(keys).alias("key"))


def _dealt(keyed: DataFrame) -> DataFrame:
    """Rows (fp, bit, key, blocks), where a key with blocks becomes one key for every pair of its blocks."""
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, own).cast("long") * F.col("blocks") + F.greatest(x, own))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    return keyed.select("fp", "bit", "key", F.explode(pairs).alias("pair")).select("fp", "bit", F.when(F.col("pair") == 0, F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key"))


def _with_blocks(keyed: DataFrame, large: DataFrame) -> tuple[DataFrame, int]:
    """keyed with the blocks of its large keys, and the most blocks of one."""
    n, most = large.agg(F.count("*"), F.coalesce(F.max("blocks"), F.lit(0))).first()
    if not n:
        return keyed.withColumn("blocks", F.lit(None).cast("int")), 0
    return keyed.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, "key", "left"), most


def near_pairs(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints of table fps (fp) that make the same components as all pairs at most `distance` bits apart.

    A signature that more than `block` fingerprints share is cut into numbered blocks by the fingerprint's hash, and every
    pair of its blocks is compared on its own, so no task takes more than two blocks of one signature at a time. Where that
    would be over `split` blocks, its fingerprints first fall apart by finer signatures, and only those of these that are
    large again are compared by blocks.
    """
    if not 0 <= distance < 2 * len(SEGMENTS):
        raise ValueError(f"{len(SEGMENTS)} segments with one wildcard find all pairs up to {2 * len(SEGMENTS) - 1} bits apart, not {distance}")
    fps = fps.select("fp").distinct()
    keyed, most = _with_blocks(signatures(fps), stored(large_signatures(fps, block)))
    dealt = _dealt(keyed.where(F.coalesce("blocks", F.lit(0)) <= split)) if most else keyed
    if most > split:
        finer = finer_signatures(keyed.where(F.col("blocks") > split), distance)
        again = finer.groupBy("key").count().where(F.col("count") > block).select("key", (F.ceil(F.col("count") / block) + 1).cast("int").alias("blocks"))
        dealt = dealt.unionByName(_dealt(_with_blocks(finer, stored(again))[0]))
    ordered = dealt.select("key", "bit", "fp").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(lambda batches: _compare(batches, distance), "a long, b long").distinct()


def _linked(marked: DataFrame, links: DataFrame | None = None, distance: int = DISTANCE) -> DataFrame:
    """(fp, component_id, first) of every fingerprint: the smallest doc_id of its component, and a fingerprint of its that has that id.

    Links are the given ones, or those between near fingerprints."""
    lowest = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    found = components(near_pairs(lowest, distance) if links is None else links)
    best = F.min(F.struct(F.col("lowest").isNull().alias("none"), "lowest", "fp")).alias("best")
    roots = found.join(lowest, found["node"] == lowest["fp"]).groupBy("root").agg(best)
    linked = found.join(roots, "root").select(F.col("node").alias("fp"), "best")
    own = F.struct(F.col("lowest").isNull().alias("none"), "lowest", "fp")
    best = F.coalesce("best", own)
    return stored(lowest.join(linked, "fp", "left").select("fp", best["lowest"].alias("component_id"), best["fp"].alias("first")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable over links, itself included).

    Null or empty text: fingerprint zero, linked like any other. A null doc_id stays null, and its component is the smallest
    id that is not null, if there is one. Repeated rows each give a row; other columns are left behind. Empty table: no rows.
    """
    marked = stored(fingerprints(docs, size))
    each = _linked(marked, distance=distance).select("fp", "component_id")
    return marked.join(each, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, marked: DataFrame, links: DataFrame | None = None, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs with one row of each component; marked has their doc_id, t and fp, links those between values of fp."""
    each = _linked(marked, links, distance)
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_n")]
    chosen = marked.join(each.where("fp = first"), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("fp").agg(F.min(F.struct(*key, F.col("t").alias("_t"))).alias("k")).select("k.*", F.lit(True).alias("_chosen"))
    rows = marked.select(*key, F.col("t").alias("_t")).groupBy("_d", "_n", "_t").count()
    state = stored(rows.join(chosen, ["_d", "_n", "_t"], "left").select("_d", "_n", "_t", F.coalesce("_chosen", F.lit(False)).alias("_chosen"), (F.col("count") > 1).alias("_again")).where("not _chosen or _again"))
    n = state.count()
    state = F.broadcast(state) if n <= BROADCAST_ROWS else state
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *key, text.alias("_t")).join(state, ["_d", "_n", "_t"], "left")
    sole = whole.where("_chosen is null").select("_row.*")
    # Chosen rows that are there more than once: one of them stays.
    again = whole.where("_chosen").dropDuplicates(["_d", "_n", "_t"]).select("_row.*")
    return sole.unionByName(again)
