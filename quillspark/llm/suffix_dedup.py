"""Operator 3: exact substring deduplication by distributed prefix doubling over sampled suffixes.

Spark ranks suffixes by ever longer prefixes: it sorts pairs (rank at a position, rank at an offset behind it), a pair's
place in that order is the rank of the prefix twice as long, and suffixes whose pair is unique are out. From quarters of the
prefix wanted, offsets of one and of two quarters lead to it. What keeps this small is which suffixes take part: content alone
marks a place in each window of `size` bytes, and windows that share a mark share the suffix ranked for them, so that a first
threshold of over half of `size` needs one suffix for about 80 bytes. Only runs of windows whose common string repeats but
whose surroundings differ are cut finer, with thresholds nearer to `size`, down to single windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import joined_runs, stored
from .sampled_positions import SEGMENT, Names, marks, nodes

#: Bytes of a string that counts as a repeat.
SIZE = 400
#: Windows that one suffix stands for, by threshold; its prefix has size - width + 1 bytes.
WIDTHS = (129, 17, 1)
#: Most bytes of lists of runs that are sent to all tasks; above, the join shuffles.
BROADCAST_BYTES = 8 << 20
#: Most places in the bit table that hints which names repeat, 8 or more for a name: 64 MB. Where that is too few, a join tells.
PLACES = 1 << 29

#: Words of a passage that counts as a repeat in the pipeline, and bytes of a word's hash there.
PASSAGE, WORD = 51, 6
PASSAGE_WIDTHS = (99, 15, 1)
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")

Encode = Callable[[str], bytes]

QUARTERS = ["n0", "n1", "n2", "n3"]
NODE = "d long, t long, p int, u int, v int, " + "".join(f"{n} long, " for n in QUARTERS) + "f long"
COLUMNS = [x.split()[0] for x in NODE.split(", ")]


def _key(docs: DataFrame) -> list[Column]:
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("d"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("t")]


def keyed(docs: DataFrame) -> DataFrame:
    """Texts (null: empty) with their key: d, the id (null: 0), and t, a hash of the text. Rows with one key are copies."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(*_key(docs), text.alias("text"))


def word_hashes(text: str) -> bytes:
    """A text as its words' hashes of WORD bytes, so that a passage is a string whatever white space is in it."""
    import xxhash

    digest = xxhash.xxh3_64_digest
    return b"".join([digest(w)[:WORD] for w in text.encode().split()])  # bytes split at exactly \x20 and \x09-\x0D


def _places(names: int) -> int:
    """Places of a bit table for so many names, a power of two."""
    return max(1 << 20, 1 << (8 * names - 1).bit_length())


def _bits(names: DataFrame, column: str, places: int) -> np.ndarray:
    """A bit for each name, at its low bits."""
    at = F.col(column).bitwiseAND(F.lit(places - 1))
    words = names.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(places >> 6, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint64)


def _set(table: np.ndarray, names: np.ndarray) -> np.ndarray:
    low = names.view(np.uint64) & np.uint64(64 * len(table) - 1)
    return (table[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def _hinted(texts: DataFrame, hint, wanted: bool) -> DataFrame:
    """Rows of texts whose t has its bit set, or has not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_set(hint.value, b.column("t").to_numpy()) == wanted))

    return texts.mapInArrow(run, texts.schema)


def _with(texts: DataFrame, lists: DataFrame, left: bool = False) -> DataFrame:
    """texts joined with a table of runs by key: sent to all tasks if small; else only texts that may have a list are shuffled."""
    how = "left" if left else "inner"
    rows, runs = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    if 64 * rows + 16 * runs <= BROADCAST_BYTES:
        return texts.join(F.broadcast(lists), ["d", "t"], how)
    if _places(rows) > PLACES:
        return texts.join(lists, ["d", "t"], how)
    hint = texts.sparkSession.sparkContext.broadcast(_bits(lists, "t", _places(rows)))
    found = _hinted(texts, hint, True).join(lists, ["d", "t"], how)
    if not left:
        return found
    return found.unionByName(_hinted(texts, hint, False), allowMissingColumns=True)


def _runs(data: bytes, wanted: list[tuple[int, int]], base: int, width: int, size: int) -> Iterator[tuple]:
    """Names, u, v and anchor (both from where the names start), and that start, of the runs of at most `width` windows that
    these runs of windows are made of; data starts at base."""
    parts = [(a, min(a + SEGMENT - 1, last)) for first, last in wanted for a in range(first, last + 1, SEGMENT)]
    for block, inside in _segments(parts):
        piece = data[block - base : inside[-1][1] + size - base]
        names = Names(piece)
        mark = marks(names, len(piece) - size + 1, size)
        for first, last in inside:
            yield names, *nodes(mark, first - block, last - block, width), block


def _named(data: bytes, wanted: list[tuple[int, int]], base: int, width: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """u, v, the names of the four quarters of the prefix, which may overlap, and f, the name of all that the run covers."""
    length = size - width + 1
    quarter = -(-length // 4)
    for names, u, v, at, block in _runs(data, wanted, base, width, size):
        quarters = [names.of(at + x, at + x + quarter).view(np.int64) for x in (0, quarter, length - 2 * quarter, length - quarter)]
        f = names.of(u, v + size) ^ (v - u).astype(np.uint64)
        yield (u + block).astype(np.int32), (v + block).astype(np.int32), *quarters, f.view(np.int64)


def _batch(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], columns)


def _whole_names(data: bytes, width: int, size: int) -> Iterator[np.ndarray]:
    """The name of the whole prefix of every run of a text."""
    for names, _, _, at, _ in _runs(data, [(0, len(data) - size)], 0, width, size):
        yield names.of(at, at + size - width + 1).view(np.int64)


def _first_names(texts: DataFrame, width: int, size: int, encode: Encode) -> DataFrame:
    """w, the name of the whole prefix, of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                found = [(w,) for t in b.column(0).slice(i, 256).to_pylist() for w in _whole_names(encode(t), width, size)]
                if found:
                    yield _batch(found, ["w"])

    return texts.select("text").mapInArrow(run, "w long")


def _first_nodes(texts: DataFrame, width: int, size: int, often: DataFrame, encode: Encode) -> DataFrame:
    """The runs of all texts whose prefix's name is in `often`, or may be."""
    places = _places(often.count())
    hint = texts.sparkSession.sparkContext.broadcast(_bits(often, "w", places)) if places <= PLACES else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, out = b.slice(i, 256), []
                for d, t, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    data = encode(text)
                    whole = zip(_whole_names(data, width, size), _named(data, [(0, len(data) - size)], 0, width, size), strict=True)
                    for w, (u, v, *names) in whole:
                        k = np.arange(len(w)) if hint is None else np.flatnonzero(_set(hint.value, w))
                        out.append((np.full(len(k), d), np.full(len(k), t), u[k], u[k], v[k], *(n[k] for n in names), w[k]))
                if out:
                    yield _batch(out, [*COLUMNS, "w"])

    nodes_of = texts.select("d", "t", "text").mapInArrow(run, f"{NODE}, w long")
    return (nodes_of if hint else nodes_of.join(often, "w", "left_semi")).drop("w")


def _pieces(texts: DataFrame, size: int, encode: Encode) -> DataFrame:
    """The bytes of each run of windows of texts' lists (u, v): p is where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                rows = []
                for d, t, text, runs in zip(*(c.to_pylist() for c in b.slice(i, 64).columns), strict=True):
                    data = encode(text)
                    rows += [(d, t, r["u"], data[r["u"] : r["v"] + size], [r]) for r in runs]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("u", pa.int32()), ("v", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["d", "t", "p", "data", "runs"])

    return texts.select("d", "t", "text", "runs").mapInArrow(run, "d long, t long, p int, data binary, runs array<struct<u:int,v:int>>")


def _next_nodes(pieces: DataFrame, width: int, size: int) -> DataFrame:
    """The given runs of pieces, cut finer, with names for a longer prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                out = []
                for d, t, p, data, runs in zip(*(c.to_pylist() for c in b.slice(i, 512).columns), strict=True):
                    for u, v, *names in _named(data, [(r["u"], r["v"]) for r in runs], p, width, size):
                        out.append((np.full(len(u), d), np.full(len(u), t), np.full(len(u), p, np.int32), u, v, *names))
                if out:
                    yield _batch(out, COLUMNS)

    return pieces.select("d", "t", "p", "data", "runs").mapInArrow(run, NODE)


def _segments(wanted: list[tuple[int, int]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Runs that are near each other, with where their bytes begin, so that a long text is taken in parts."""
    held: list[tuple[int, int]] = []
    for run in sorted(wanted):
        if held and run[1] - held[0][0] >= SEGMENT:
            yield held[0][0], held
            held = []
        held.append(run)
    if held:
        yield held[0][0], held


def _ranks(pairs: DataFrame) -> DataFrame:
    """(a, b, rank) of the pairs that occur more than once: Spark sorts them, and a rank is a place in that order."""
    often = stored(pairs.groupBy("a", "b").count().where("count > 1").select("a", "b"))
    return stored(often.orderBy("a", "b").select("a", "b", F.monotonically_increasing_id().alias("rank")))


def _doubled(nodes: DataFrame) -> DataFrame:
    """d, t, p, u, v, f, r0, r1 of the nodes whose halves both repeat: the ranks of the halves from the pairs of quarters."""
    first, second = (F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (QUARTERS[:2], QUARTERS[2:]))
    ranks = _ranks(nodes.select(F.explode(F.array(first, second)).alias("x")).select("x.*"))
    for k, (a, b) in enumerate((QUARTERS[:2], QUARTERS[2:])):
        nodes = nodes.join(ranks.select(F.col("a").alias(a), F.col("b").alias(b), F.col("rank").alias(f"r{k}")), [a, b]).drop(a, b)
    return nodes


def _labelled(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (stored) whose covered string occurs again, and nodes whose prefix repeats with other surroundings: one of each
    kind of those that cover the same. Tables that meet in a join are stored, so that Spark can split a frequent pair's rows."""
    ranked = stored(_doubled(nodes))
    common = stored(ranked.groupBy("r0", "r1").agg(F.count("*").alias("total"), (F.min("f") != F.max("f")).alias("mixed")).where("total > 1").drop("total"))
    known = stored(ranked.join(common, ["r0", "r1"]))
    mixed = known.where("mixed")
    alike = stored(mixed.groupBy("r0", "r1", "f").agg(F.count("*").alias("copies"), F.min(F.struct("d", "t", "u")).alias("chosen")))
    kinds = stored(mixed.join(alike, ["r0", "r1", "f"]))
    columns = ["d", "t", "p", "u", "v"]
    found = known.where("not mixed").select(columns).unionByName(kinds.where("copies > 1").select(columns))
    return found, kinds.where(F.col("chosen") == F.struct("d", "t", "u")).select(columns).distinct()


def repeated_runs(docs: DataFrame, size: int = SIZE, widths: tuple[int, ...] = WIDTHS, encode: Encode = str.encode, least: int | None = None) -> DataFrame:
    """(d, t, runs): of every text with a byte in a string of `size` bytes that starts anywhere else too, the maximal runs
    (start, end) of such bytes, in order. A text that occurs in no other place is not there.

    Bytes are those that `encode` makes of a text; only texts of `least` bytes (else `size`) can have so many."""
    texts = keyed(docs).where(F.octet_length("text") >= (size if least is None else least))
    # Most prefixes are unique: only names that may repeat go on, with all that belongs to them.
    often = stored(_first_names(texts, widths[0], size, encode).groupBy("w").count().where("count > 1").select("w"))
    found, nodes_of = [], _first_nodes(texts, widths[0], size, often, encode)
    for step in range(len(widths)):
        repeated, going = _labelled(stored(nodes_of))
        found.append(repeated.select("d", "t", "u", (F.col("v") + size).alias("end")))
        if step + 1 == len(widths) or going.isEmpty():
            break
        if step == 0:
            lists = stored(going.groupBy("d", "t").agg(F.collect_list(F.struct("u", "v")).alias("runs")))
            pieces = stored(_pieces(_with(texts, lists), size, encode))
        else:
            lists = going.groupBy("d", "t", "p").agg(F.collect_list(F.struct("u", "v")).alias("runs"))
            pieces = pieces.drop("runs").join(lists, ["d", "t", "p"])
        nodes_of = _next_nodes(pieces, widths[step + 1], size)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return stored(spans.groupBy("d", "t").agg(F.collect_set(F.struct("u", "end")).alias("s")).select("d", "t", F.expr(joined_runs("s", "u")).alias("runs")))


def _with_runs(docs: DataFrame, runs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    whole = docs.select(*more, "doc_id", *_key(docs), text.alias("text"))
    return _with(whole, runs, left=True)


def _cut(data: bytes, runs: list[dict] | None) -> bytes:
    parts, at = [], 0
    for r in () if runs is None else runs:
        parts.append(data[at : r["start"]])
        at = r["end"]
    return b"".join([*parts, data[at:]])


def suffix_dedup(docs: DataFrame, size: int = SIZE, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text, without each byte that lies in a string of
    `size` bytes which also starts anywhere else in the table.

    Null or empty text: 0, 0, 0 and the digest of nothing. Repeated rows are copies of each other, and go if long enough; a
    null doc_id stays null; other columns are left behind. Empty table: no rows. Equality is that of 256 bits of names.
    Very long texts are taken in parts of about a million windows; a frequent passage's rows are split over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode()
                kept = _cut(data, runs)
                rows.append((len(data), len(data) - len(kept), len(runs or ()), hashlib.sha256(kept).hexdigest()))
            n, removed, spans, digest = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _with_runs(docs, repeated_runs(docs, size, widths)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut_words(data: bytes, runs: list[dict], words: int) -> bytes:
    """data without the runs, given in bytes of its words' hashes, that hold so many whole words."""
    at = [m.span() for m in WORDS.finditer(data)]
    inside = [(-(-r["start"] // WORD), r["end"] // WORD) for r in runs]
    return _cut(data, [{"start": at[a][0], "end": at[b - 1][1]} for a, b in inside if b - a >= words])


def without_passages(docs: DataFrame, words: int = PASSAGE, widths: tuple[int, ...] = PASSAGE_WIDTHS) -> DataFrame:
    """docs, all columns, without each word that lies in a run of `words` words which also starts anywhere else in the table,
    and without the white space inside such runs; n_chars (if there) is counted again.

    A null text stays null. Repeated rows, whatever their ids, are copies of each other; all rows stay. Long texts are taken in
    parts; columns may have any names. Empty table: no rows.
    """
    return _cleaned(docs, lambda whole: repeated_runs(whole, words * WORD, widths, word_hashes, 2 * words - 1), lambda data, runs: _cut_words(data, runs, words))


def _cleaned(docs: DataFrame, find: Callable[[DataFrame], DataFrame], cut: Callable[[bytes, list[dict]], bytes]) -> DataFrame:
    # The other columns travel as one struct, so that none clashes with the runs' and the text is there once.
    others = [docs[c] for c in docs.columns if c != "text"]
    row = F.struct(F.struct(*others).alias("others"), docs["text"].isNull().alias("none"))
    whole = docs.select("doc_id", "text", row.alias("_row"))

    @F.pandas_udf(StringType())
    def clean(text, runs):
        return text.combine(runs, lambda t, r: t if r is None or not len(r) else cut(t.encode(), r).decode("utf-8", "ignore"))

    out = _with_runs(whole, find(whole), "_row")
    out = out.withColumn("clean", F.when(F.col("runs").isNull(), F.col("text")).otherwise(clean("text", "runs")))
    out = out.withColumn("clean", F.when(~F.col("_row.none"), F.col("clean")))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col("_row.others")[c].alias(c) for c in docs.columns])
