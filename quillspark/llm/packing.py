"""Operator 9: sum-of-squares packing of documents into sequences of bounded length.

A piece goes where the squares of the numbers of open sequences, by the room they have left, sum to least.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts
from .library_ids import VOCABULARY, library_ids

CAPACITY = 1024
#: Pieces that one task packs together; more pieces make more tasks, each with sequences of its own.
GROUP = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the order given. Lengths are from 1 to capacity."""
    # Cost of having one more sequence with r left, and gain of one fewer with g left; full sequences don't count.
    more = np.ones(capacity + 1)
    more[0] = 0
    fewer = np.full(capacity + 1, -np.inf)
    fewer[capacity] = 0  # a new sequence is always there
    count = [0] * (capacity + 1)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        left = int(np.argmin(more[: capacity + 1 - size] - fewer[size:]))  # of equal ones that with the least room left
        room = left + size
        if room == capacity:
            at, n = n, n + 1
        else:
            at = open_by_room[room].pop()
            count[room] -= 1
            more[room] -= 2
            fewer[room] = 2 * count[room] - 1 if count[room] else -np.inf
        if left:
            open_by_room[left].append(at)
            count[left] += 1
            more[left] += 2
            fewer[left] = 2 * count[left] - 1
        sequence[i], offset[i] = at, capacity - room
    return sequence, offset


def packing(own: pd.DataFrame, capacity: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    return own, *sum_of_squares(own["length"].to_numpy(), capacity)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only what is longer than capacity is cut, and only its first piece may be shorter."""
    head = n % capacity
    starts = [*([0] if head else []), *range(head, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every whole text (null: only the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = library_ids(vocabulary), struct.pack("<I", end_id)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                rows += [(doc, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(ids) // 4, capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return texts(docs).mapInArrow(run, PIECES)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces. Full pieces are sequences as they are (negative numbers);
    the others are dealt to tasks of about `group` pieces, by id, piece and (if there) a row number. Each packs its own in mixed order (better for many) and longest
    first (better for few), and keeps what takes fewer sequences."""
    short = cut_pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat([*parts, pd.DataFrame()])
        if len(own):
            own = own.sort_values(["ids_crc32", "doc_id", "piece"])  # in no order of length
            own, sequence, offset = min((packing(x, capacity) for x in (own, own.sort_values("length", ascending=False, kind="stable"))), key=lambda x: x[1].max())
            own["sequence_id"], own["offset"] = (TaskContext.get().partitionId() << 32) + sequence, offset
            yield own

    packed = short.repartition(groups, "doc_id", "piece", *(["row"] if "row" in short.columns else [])).drop("row").mapInPandas(run, PIECES + ", sequence_id long, offset long")
    full = cut_pieces.where(F.col("length") == capacity).drop("row")
    return packed.unionByName(full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = 2, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text: one piece with the end id. Repeated rows are packed each; a null doc_id stays null; other columns
    are left behind. A long text makes as many pieces as it needs. Empty table: no rows.
    """
    # Once stored, row numbers are fixed; they deal out the pieces of repeated or null ids.
    numbered = pieces(docs, vocabulary, end_id, capacity).withColumn("row", F.monotonically_increasing_id())
    return pack(stored(numbered), capacity, group)
