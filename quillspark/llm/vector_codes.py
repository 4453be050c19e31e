"""Operator 12: vector codes by product quantisation, with Hamerly's Lloyd rounds in whole numbers.

Every part of a vector keeps, from round to round, an upper bound of the distance to its entry and a lower bound of the
distance to any other. When entries move, the bounds move with them. Only parts whose upper bound isn't strictly below the lower
one (or half the way from its entry to the next) are compared with all entries, in integers, so that ties still go to the
lower index. Bounds are floats, rounded outwards, and never decide anything that they don't prove.

A round is one job: it reads the last round's table, writes the next, and puts its partition's sums of each entry in a
row beside it. Only these sums meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that a task compares at a time, and labels that are broadcast.
ROWS, BROADCAST_ROWS = 4096, 100_000
#: Relative error beyond that of a few operations in doubles.
SLACK = 1e-12

_STATE = "vec_id long, label string, v array<bigint>, code binary, upper binary, lower binary, error long, kept boolean, sums binary"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (as text), v: floor(scale * x) of each component. Vectors that are null or hold null or non-finite components go."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    # Components of more than 18 digits have no integer; they become null here and uncodable below.
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 1e18 / scale, F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))
    return vectors.where(F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), whole.alias("v"))


def _largest(length: int) -> int:
    """Components up to this size can't overflow a vector's squared distance, nor the sum of 2^31 components."""
    return min(2**31, int((2**60 // max(length, 1)) ** 0.5))


def _cuts(length: int) -> list[int]:
    return [length * p // PARTS for p in range(PARTS + 1)]


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry: by doubles where these hold all sums, else by integers."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * peak * peak * max(x.shape[1], 1) < 2**53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


class Book:
    """One part's entries, how far each has moved since the last round, and half the distance from each to the next."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        between = squares(entries, entries).astype(np.float64)
        np.fill_diagonal(between, np.inf)
        self.half = np.sqrt(between.min(1)) * (0.5 - SLACK)
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        self.moved = moved
        # The furthest that any entry but this one has moved.
        order = np.argsort(moved)
        self.others = np.full(len(entries), moved[order[-1]])
        self.others[order[-1]] = moved[order[-2]] if len(entries) > 1 else 0.0

    def assigned(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring code and bounds up to date, in place; how many parts needed the full scan."""
        upper += self.moved[code]
        upper *= 1 + SLACK
        lower -= self.others[code]
        lower -= np.abs(lower) * SLACK
        proof = np.maximum(lower, self.half[code])
        open_ = np.flatnonzero(~(upper < proof))
        # A tighter upper bound first: the true distance to its own entry.
        own = ((x[open_] - self.entries[code[open_]]) ** 2).sum(1)
        upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
        open_ = open_[~(upper[open_] < proof[open_])]
        if len(open_):
            far = squares(x[open_], self.entries)
            code[open_] = far.argmin(1)  # the first of equals
            near = np.partition(far, min(1, far.shape[1] - 1), axis=1)
            upper[open_] = np.sqrt(near[:, 0].astype(np.float64)) * (1 + SLACK)
            lower[open_] = np.sqrt(near[:, 1].astype(np.float64)) * (1 - SLACK) if far.shape[1] > 1 else np.inf
        return len(open_)


def _matrix(values: pa.Array, length: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def _round(state: DataFrame, books: list[Book], length: int, last: bool) -> DataFrame:
    """The next state: rows' codes and bounds by these books, and a row with the partition's sums of each entry."""
    given = state.sparkSession.sparkContext.broadcast(books)
    cuts = _cuts(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = given.value
        n = len(books[0].entries)
        sums, sizes, scans = np.zeros((n, length), np.int64), np.zeros((n, PARTS), np.int64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = _matrix(part.column(2), length)
                packed = [b"".join(part.column(c).to_pylist()) for c in (3, 4, 5)]
                code = np.frombuffer(packed[0], np.uint8).reshape(-1, PARTS).astype(np.int64)
                upper, lower = (np.frombuffer(b, np.float64).reshape(-1, PARTS).copy() for b in packed[1:])
                error = np.zeros(len(x), np.int64)
                for p, book in enumerate(books):
                    own = np.ascontiguousarray(x[:, cuts[p] : cuts[p + 1]])
                    c, u, low = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                    scans += book.assigned(own, c, u, low)
                    code[:, p], upper[:, p], lower[:, p] = c, u, low
                    if last:
                        error += ((own - book.entries[c]) ** 2).sum(1)
                    else:
                        np.add.at(sums[:, cuts[p] : cuts[p + 1]], c, own)
                        sizes[:, p] += np.bincount(c, minlength=n)
                rows = [
                    part.column(0), part.column(1), part.column(2), _binary(code.astype(np.uint8)), _binary(upper), _binary(lower),
                    pa.array(error if last else [None] * len(x), pa.int64()), pa.array([True] * len(x)), pa.nulls(len(x), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(rows, names)
        own = np.concatenate([sums.ravel(), sizes.ravel(), [scans]]).tobytes()
        kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([False]), pa.array([own], pa.binary())], names)

    names = [x.split()[0] for x in _STATE.split(", ")]
    return state.mapInArrow(run, _STATE)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as a value."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows[0].nbytes), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _moved(written: DataFrame, books: list[Book], length: int) -> tuple[list[Book], int]:
    """The books after a round, from the sums of all its partitions, merged in a tree; and how many full scans it took."""
    vectors = written.where(~F.col("kept")).select("sums").rdd.map(lambda r: np.frombuffer(r.sums, np.int64))
    total = vectors.treeReduce(np.add)
    n, cuts = len(books[0].entries), _cuts(length)
    sums, sizes = total[: n * length].reshape(n, length), total[n * length : -1].reshape(n, PARTS)
    after = []
    for p, book in enumerate(books):
        used = sizes[:, p] > 0
        entries = book.entries.copy()
        entries[used] = sums[used, cuts[p] : cuts[p + 1]] // sizes[used, p][:, None]
        after.append(Book(entries, book.entries))
    return after, int(total[-1])


def books_digest(books: list[Book]) -> str:
    """SHA-256 of all entries' components by part, entry and position, in decimal with commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()


def trained(kept: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[Book], int, list[int]]:
    """Rows' last codes and errors, the final books, the vectors' length and the full scans of each round.

    Books start as the parts of the `entries` first vectors by vec_id (nulls last; of equal ids, smaller vectors first).
    """
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v", "label").limit(entries).collect()
    length = len(first[0].v) if first else 0
    most = _largest(length)
    fits = F.coalesce((F.size("v") == length) & F.forall("v", lambda x: F.coalesce(F.abs(x) <= most, F.lit(False))), F.lit(False))
    start = [r.v for r in first if len(r.v) == length and all(x is not None and abs(x) <= most for x in r.v)]
    if not start or not length:
        start, length, fits = [], length, F.lit(False)
    none = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if not start:
        return none, [], length, []
    x, cuts = np.array(start, np.int64), _cuts(length)
    books = [Book(x[:, cuts[p] : cuts[p + 1]].copy()) for p in range(PARTS)]
    unknown = np.full(PARTS, np.inf).tobytes(), np.full(PARTS, -np.inf).tobytes()
    state = kept.where(fits).select("vec_id", "label", "v", F.lit(bytes(PARTS)).alias("code"), F.lit(unknown[0]).alias("upper"), F.lit(unknown[1]).alias("lower"))
    scans, old = [], None
    for k in range(rounds + 1):
        written = stored(_round(state, books, length, k == rounds))
        if old is not None:
            discard(old)
        if k < rounds:
            books, n = _moved(written, books, length)
            scans.append(n)
        old, state = written, written.where("kept").select("vec_id", "label", "v", "code", "upper", "lower")
    return written.where("kept").select("vec_id", "label", "code", "error").unionByName(none), books, length, scans


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector.

    Vectors that are null or hold null or non-finite components are left out. Repeated rows count each; a null vec_id stays null
    and is last among the books' first vectors; null labels share a label_error. Parts are as equal as the length allows.
    Vectors that are empty, of another length than the smallest vec_id's, or with a component so large that a distance would
    not fit 63 bits are kept with null code and error, take no part in the books, and add nothing to their label's error; a
    sum beyond 63 bits is null. Empty table: no rows. Other columns are left behind.
    """
    kept = stored(quantised(vectors, scale))
    rows, books, _, _ = trained(kept, rounds, entries)
    of_label = rows.groupBy(F.col("label").alias("_label")).agg(F.expr("try_sum(error)").alias("label_error"))
    of_label = stored(of_label)
    of_label = F.broadcast(of_label) if of_label.count() <= BROADCAST_ROWS else of_label
    code = F.lower(F.hex("code"))
    out = rows.join(of_label, rows["label"].eqNullSafe(F.col("_label")))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds written out, without bounds: every part meets every entry each time."""
    steps = [
        f"""v as materialized (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select r, p, list_slice(e, p * (len(e) // {PARTS}) + 1, (p + 1) * (len(e) // {PARTS})) as x from v, range({PARTS}) t(p)),
b0 as materialized (select p, r - 1 as k, x as c from s where r <= {ENTRIES})"""
    ]
    for n in range(ROUNDS + 1):
        steps.append(
            f"""a{n} as materialized (select r, p, any_value(x) as x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, k := k)) as best from s join b{n} using (p) group by r, p)"""
        )
        if n < ROUNDS:
            steps.append(
                f"""m{n} as materialized (select p, best.k as k, i, floor(sum(x[i + 1])::double / count(*))::bigint as y from a{n}, range(len(x)) t(i) group by all),
b{n + 1} as materialized (select p, k, coalesce(n.c, o.c) as c from b{n} o left join (select p, k, list(y order by i) as c from m{n} group by p, k) n using (p, k))"""
            )
    last = f"a{ROUNDS}"
    return (
        "with "
        + ",\n".join(steps)
        + f""",
h as (select sha256(string_agg(y, ',' order by p, k)) as codebooks_sha256 from (select p, k, array_to_string(c, ',') as y from b{ROUNDS})),
o as (select r, string_agg(printf('%02x', best.k::int), '' order by p) as code, sum(best.d)::bigint as error from {last} group by r)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from v join o using (r), h"""
    )


ORACLE = _oracle()
