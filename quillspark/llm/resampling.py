"""Operator 13: importance resampling of documents towards a target's texts, by hashed words and pairs of words.

Two Arrow passes. In the first each partition counts the buckets of its features into one vector, and vectors are merged in
a tree. What a bucket gains is then known everywhere, and the second pass sums the gains of each document's features. Bytes
are hashed in arrays: all words of a slice of texts advance by one byte at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import placed
from .common import discard, stored, texts

BUCKETS = 10_000
#: Of the documents with at least LEAST_WORDS words, PERCENT of a hundred are drawn.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of text that a task hashes at a time (a longer text alone), and words so long that they are hashed one by one.
SLICE, LONG = 1 << 20, 64


def _crc_table() -> np.ndarray:
    """CRC-32's step for each byte."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


STEPS = _crc_table()
_bytes = np.arange(256)
CAPITAL = (_bytes >= 65) & (_bytes <= 90)
LOWER = np.where(CAPITAL, _bytes + 32, _bytes).astype(np.uint8)
#: Bytes of words: digits, letters, and all beyond ASCII.
IN_WORD = (_bytes >= 128) | ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122))


def _advanced(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the next size[i] bytes from start[i]."""
    out = state.copy()
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = np.flatnonzero(size <= LONG)
    order = short[np.argsort(-size[short], kind="stable")]
    at, now = start[order], state[order]
    longer = len(order) - np.cumsum(np.bincount(size[order], minlength=1))  # how many have more than k bytes
    for k, n in enumerate(longer.tolist()):
        now[:n] = STEPS[(now[:n] ^ data[at[:n] + k]) & 255] ^ (now[:n] >> 8)
    out[order] = now
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other in `data`, text i from offsets[i] to offsets[i + 1]: the bucket of every feature
    and the text it is in, words first, and the number of words of each text."""
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # no word runs from one text into the next
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    text = np.searchsorted(offsets, start, "right") - 1
    size = end - start
    first = _advanced(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start, size)
    pair = np.flatnonzero(text[1:] == text[:-1])
    spaced = STEPS[(first[pair] ^ 32) & 255] ^ (first[pair] >> 8)
    second = _advanced(spaced, data, start[pair + 1], size[pair + 1])
    found = np.concatenate([first, second]) ^ np.uint32(0xFFFFFFFF)
    return (found % np.uint32(buckets)).astype(np.int64), np.concatenate([text, text[pair]]), np.bincount(text, minlength=len(offsets) - 1)


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows whose texts have up to SLICE bytes together, or one row, with the texts' bytes and offsets."""
    for batch in batches:
        values = batch.column(column).cast(pa.large_string())
        if not len(values):
            continue
        _, where, data = values.buffers()
        offsets = np.frombuffer(where, np.int64)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(values):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all whole texts (null: none) fall into each bucket: one vector a partition, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in _slices(batches, 0):
            total += np.bincount(features(data, offsets, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    vectors = rows.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda r: np.frombuffer(r.counts, np.int64)).treeReduce(np.add)


def gains(of_all: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """A bucket's logarithmic ratio of the target's share to the documents', each smoothed by one, in thousandths, rounded down."""
    s, t, n = int(of_all.sum()), int(of_target.sum()), len(of_all)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(of_all.tolist(), of_target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight, n_words of each whole text: the floored mean of its features' gains (none: 0)."""
    given = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _slices(batches, 1):
            bucket, text, words = features(data, offsets, len(given.value))
            n = np.bincount(text, minlength=part.num_rows)
            total = np.bincount(text, weights=given.value[bucket], minlength=part.num_rows).astype(np.int64)  # exact below 2^53
            columns = [part.column(0), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1)), pa.array(words.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "weight", "n_words"])

    return texts(docs).mapInArrow(run, "doc_id long, n_features long, weight long, n_words long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs: drawn rows, `percent` of a hundred of those with at least
    `least_words` words, have a rank from 1 by falling score, ties to smaller doc_ids; others have none.

    A score is the weight and Gumbel noise from a hash of seed and doc_id, so the draw is without replacement and in proportion
    to the weights, and the same whatever the partitions. Null and empty texts have no features, weight 0. A null doc_id stays
    null, hashes as an empty one and comes first among equal scores. Repeated rows count and compete each; rows with equal
    score and doc_id have some order. Texts and words of any length are read whole; other columns are left behind. An empty
    target makes its smoothed shares equal. Empty table: no rows.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stored(weighed(docs, gain).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= least_words
    ranked = placed(scored, (~enough).alias("short"), F.desc("score"), "doc_id", "row")
    discard(scored)
    drawn = ranked.where(enough).count() * percent // 100
    rank = F.when(enough & (F.col("place") < drawn), F.col("place") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


_CRC = ", ".join(f"{x}::bigint" for x in STEPS.tolist())
#: CRC-32 by folding a feature's bytes: DuckDB has no function for it.
ORACLE = f"""
with recursive steps as materialized (select [{_CRC}] as t),
w as materialized (select 'd' as side, row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents
  union all select 'b', row_number() over (), null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
f as materialized (select side, r, feature, count(*) as n from (select side, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as feature from w) group by all),
distinct_f as (select feature, hex(encode(feature)) as x from (select distinct feature from f)),
crc as materialized (select feature, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) % {BUCKETS} as bucket from distinct_f, steps),
c as materialized (select bucket, sum(n) filter (side = 'd') as s, sum(n) filter (side = 'b') as t from f join crc using (feature) group by bucket),
total as (select coalesce(sum(s), 0)::double as s, coalesce(sum(t), 0)::double as t from c),
g as materialized (select bucket, floor(1000 * ln((coalesce(c.t, 0) + 1) * (total.s + {BUCKETS}) / ((coalesce(c.s, 0) + 1) * (total.t + {BUCKETS}))))::bigint as gain from c, total),
m as (select r, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight from f join crc using (feature) join g using (bucket) where side = 'd' group by r),
d as (select w.doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(w.doc_id::varchar, ''))[1:8])::bigint + 0.5) / 4294967296)))::bigint as score from w left join m using (r) where side = 'd'),
k as (select count(*) * {PERCENT} // 100 as drawn from d where n_words >= {LEAST_WORDS}),
o as (select *, row_number() over (partition by n_words >= {LEAST_WORDS} order by score desc, doc_id) as place from d)
select doc_id, n_features, weight, score, case when n_words >= {LEAST_WORDS} and place <= drawn then place end as rank from o, k
"""
