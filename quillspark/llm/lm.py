"""Operator 1: a log-bilinear neural language model, trained by noise-contrastive estimation and scored by matrix products.

The model predicts the class of a token from the classes of the two before it. A frequent word is a class of its own; every
other word is in the class of its ending, known or not, in which it keeps its share of the corpus counts. So a rare word
tells as context, and gets as target, what words of its form have in common. Scores add a row for each earlier class, so all
normalisers come from one product of two exponentiated score matrices, and every probability is exact.

Training doesn't depend on partitions: texts are dealt to rounds and shards, and ordered, by their own hash. Words are split
and looked up by Arrow, once for counts and once for classes; rounds and scores read the classes that this has stored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Classes at most: 0 is the end of a text (and what stands before its start), then frequent words, then ENDINGS of the others.
#: Words that are a class of their own grow as twice the root of the training tokens up to this.
CLASSES, ENDINGS = 2048, 256
WIDTH = 32
#: The most frequent words, of at most LONGEST bytes, that every task knows; others are looked up by a join.
HEAD, LONGEST = 100_000, 64
#: Noise tokens for each batch of true ones.
NOISE, BATCH, RATE = 128, 2048, 0.15
#: Of 16 parts of the training texts, those that the rounds end with; all shards of a round start from the last one's average.
ROUNDS = (1, 4, 9, 16)
#: Training tokens of a shard, about.
SHARD = 1_000_000
FLUSH = 400_000
#: Bytes of texts that are taken at once, and of their classes, which scoring makes many times larger.
SLICE, CODED = 1 << 22, 1 << 19


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as bytes, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # A-Z alone; splits at exactly \x20 and \x09-\x0D
    every = parts.flatten().cast(pa.binary())
    words = pc.greater(pc.binary_length(every), 0)  # the ends of a text give empty parts
    upto = np.r_[0, np.cumsum(words.to_numpy(zero_copy_only=False))]
    return every.filter(words), np.diff(upto[np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy())]])


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows that have up to `most` bytes in this column together, or one row."""
    for b in batches:
        upto, i = np.r_[0, np.cumsum(pc.binary_length(b.column(column)).to_numpy().astype(np.int64))], 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), held_out: whether crc32 of the id as text (null: empty) leaves 1 when divided by 5."""
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), (F.crc32(key) % 5 == 1).alias("held_out"))


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over whole texts, counted in each task first; stored. Ends of texts are not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> pa.Table:
            return pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in _slices(batches, "text"):
            found = words_of(b.column("text"))[0].value_counts()
            held.append(pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"]))
            size += len(found)
            if size > 2 * FLUSH:
                held = merged().combine_chunks().to_batches()
                if (size := sum(x.num_rows for x in held)) > FLUSH:
                    yield from held
                    held, size = [], 0
        if held:
            yield from merged().to_batches()

    return stored(training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


@dataclass
class Corpus:
    """Counts of the training texts: total tokens, distinct tokens, texts, the most frequent words with their counts, and the
    base mass (count plus a half) of all words by ending."""

    tokens: int
    distinct: int
    texts: int
    head: list[bytes]
    counts: np.ndarray
    by_ending: np.ndarray

    @property
    def base_mass(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    @property
    def own(self) -> int:
        """Words that are a class of their own."""
        return min(len(self.head), max(0, CLASSES - 1 - len(self.by_ending)), 2 * math.isqrt(self.tokens))

    def class_mass(self) -> np.ndarray:
        """Base mass of each class; one unknown word is in each class of an ending."""
        short = self.counts[: self.own] + 0.5
        rest = self.by_ending + 0.5
        np.subtract.at(rest, [ending(w, len(rest)) for w in self.head[: self.own]], short)
        return np.r_[self.texts + 0.5, short, np.maximum(rest, 0.5)]


def ending(word: bytes, endings: int) -> int:
    """The class of a word by its last two bytes."""
    return zlib.crc32(word[-2:]) % endings


def corpus(training: DataFrame, counted: DataFrame, head: int = HEAD, endings: int = ENDINGS) -> Corpus:
    n, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    docs = training.count()
    # The head ends at an eighth of an octave of counts, so that what is collected is bounded and needs no global sort.
    fits = counted.where(F.length("word") <= LONGEST).withColumn("level", F.floor(8 * F.log2("n")).cast("int"))
    least, taken = 1 << 20, 0
    for level, words in sorted(map(tuple, fits.groupBy("level").count().collect()), reverse=True):  # at most 8 * 63 rows
        if taken + words > head:
            break
        least, taken = level, taken + words
    found = fits.where(F.col("level") >= least).select((-F.col("n")).alias("n"), "word").toArrow()  # at most head rows
    top = sorted(zip(*(c.to_pylist() for c in found.columns), strict=True))
    last = F.expr("crc32(case when length(word) < 2 then word else substring(word, length(word) - 1, 2) end)")
    by_ending = np.zeros(endings)
    for r in counted.groupBy((last % endings).alias("k")).agg(F.sum(F.col("n") + 0.5)).collect():  # at most endings rows
        by_ending[r[0]] = r[1]
    return Corpus(n + docs, distinct + (docs > 0), docs, [w for _, w in top], np.array([-n for n, _ in top], np.int64), by_ending)


class Classes:
    """Words to positions in the head (-1: not there) and to classes."""

    def __init__(self, head: list[bytes], own: int, endings: int):
        self.head, self.own, self.endings = pa.array(head, pa.binary()), own, endings
        self.of_head = np.array([*range(1, own + 1), *(own + 1 + ending(w, endings) for w in head[own:]), 0], np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy()

    def of(self, words: pa.Array, places: np.ndarray) -> np.ndarray:
        out, others = self.of_head[places], np.flatnonzero(places < 0)
        last = pc.binary_slice(words.take(pa.array(others)), -2).dictionary_encode()
        by_last = np.array([self.own + 1 + ending(x, self.endings) for x in last.dictionary.to_pylist()], np.int64)
        out[others] = by_last[last.indices.to_numpy()]
        return out


class Model:
    """score(w | v, u) = (one[v] + two[u]) . target[w] + bias[w] for w after v after u."""

    def __init__(self, tables: np.ndarray, adapted: np.ndarray | None = None):
        self.tables = tables  # (3 * classes, width + 1): one, two, target; the last column of target is the bias
        k = len(tables) // 3
        self.one, self.two, self.target = tables[:k, :-1], tables[k : 2 * k, :-1], tables[2 * k :, :-1]
        self.bias = tables[2 * k :, -1]
        self.adapted = np.full_like(tables, 1e-6) if adapted is None else adapted  # squares of past steps, summed

    @classmethod
    def start(cls, mass: np.ndarray, width: int = WIDTH, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        tables = rng.normal(0, 0.1, (3 * len(mass), width + 1)).astype(np.float32)
        tables[: 2 * len(mass)] *= 0.1
        tables[:, -1] = 0
        tables[2 * len(mass) :, -1] = np.log(mass / mass.sum())
        return cls(tables)

    def train(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
        """One step of noise-contrastive estimation: true tokens w against shared noise, each as if drawn with its probability."""
        k, many, width = len(self.bias), len(noise), self.tables.shape[1]
        hidden = self.tables.take(v, axis=0) + self.tables.take(k + u, axis=0)
        hidden[:, -1] = 1  # meets the bias
        right, wrong = self.tables.take(2 * k + w, axis=0), self.tables.take(2 * k + noise, axis=0)
        true = np.einsum("ij,ij->i", hidden, right) - log_noise[w] - np.float32(math.log(many))
        less = wrong.copy()
        less[:, -1] -= log_noise[noise] + np.float32(math.log(many))
        with np.errstate(over="ignore"):  # beyond what exp can hold, the probability is 0
            up = 1 / (1 + np.exp(true))
            down = hidden @ -less.T  # from here on in place: what takes time are passes over new memory
            np.exp(down, out=down)
        down += 1
        np.reciprocal(down, out=down)
        at_hidden = up[:, None] * right - down @ wrong
        at_hidden[:, -1] = 0
        rows = np.concatenate([at_hidden, at_hidden, up[:, None] * hidden, -(down.T @ hidden)])
        index = np.concatenate([v, k + u, 2 * k + w, 2 * k + noise])
        # Sums by row over the whole table, as one flat histogram: sorting rows takes longer. Rows that aren't met add 0.
        at = (index[:, None] * width + np.arange(width)).ravel()
        step = (np.bincount(at, rows.ravel(), self.tables.size) / len(w)).astype(np.float32).reshape(self.tables.shape)
        self.adapted += step * step
        step *= np.float32(RATE)
        step /= np.sqrt(self.adapted)
        self.tables += step

    def log_tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores by earlier class, bias, and the log of the normaliser of every pair of earlier classes."""
        k, bias, target = len(self.bias), self.bias.astype(np.float64), self.target.T.astype(np.float64)
        one, two, norm = (np.empty((k, k), np.float32) for _ in range(3))

        def by_token(rows: np.ndarray) -> np.ndarray:
            out = rows.astype(np.float64) @ target
            return np.clip(out, -40, 40, out=out)

        mass = by_token(self.two)
        two[:] = mass
        np.exp(mass, out=mass)
        mass *= np.exp(bias)
        for i in range(0, k, 256):  # the driver holds one whole table of doubles, no more
            part = by_token(self.one[i : i + 256])
            one[i : i + 256] = part
            norm[i : i + 256] = np.log(np.exp(part, out=part) @ mass.T)
        return one, two, bias, norm


def _context(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(one before, two before, token) by class, of whole texts with their ends: an end stands before what follows it."""
    v = np.r_[0, classes[:-1]]
    u = np.r_[0, v[:-1]]
    u[starts] = 0
    return np.stack([v, u, classes])


def _steps(texts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """_context of texts, given as their classes, in batches of BATCH tokens and a last one."""
    held, size, rest = [], 0, np.zeros((3, 0), np.int64)

    def every() -> np.ndarray:
        starts = np.cumsum([0, *(len(x) for x in held[:-1])])
        return np.concatenate([rest, _context(np.concatenate(held).astype(np.int64), starts)], axis=1)

    for text in texts:
        held.append(text)
        size += len(text)
        if size >= 16 * BATCH:
            ready = every()
            full = ready.shape[1] // BATCH * BATCH
            for i in range(0, full, BATCH):
                yield tuple(ready[:, i : i + BATCH])
            held, size, rest = [], 0, ready[:, full:]
    ready = every() if held else rest
    for i in range(0, ready.shape[1], BATCH):
        yield tuple(ready[:, i : i + BATCH])


def trained(dealt: DataFrame, start: Model, shards: int, mass: np.ndarray) -> Model:
    """Each shard trains a model on its texts in the order of their hashes, all from the same start; the models and their past
    steps are averaged, weighted by tokens, row by row in Spark. The texts of a shard are read as a stream, never held."""
    width = start.tables.shape[1]
    columns = [f"c{i}" for i in range(2 * width)]
    context = dealt.sparkSession.sparkContext
    given = context.broadcast((start.tables, start.adapted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = mass / mass.sum()
        log_noise, total = np.log(share).astype(np.float32), np.cumsum(share)
        kind = _kind(len(mass))
        rows = ((s, x) for b in batches for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for shard, own in groupby(rows, lambda r: r[0]):
            model, n, rng = Model(*(x.copy() for x in given.value)), 0, np.random.default_rng((11, shard))
            for v, u, w in _steps(np.frombuffer(x, kind) for _, x in own):
                noise = np.minimum(np.searchsorted(total, rng.random(NOISE)), len(mass) - 1)
                model.train(v, u, w, noise, log_noise)
                n += len(w)
            values = np.c_[model.tables, model.adapted]
            rows_of = [pa.array(np.arange(len(values))), pa.array(np.full(len(values), n))]
            yield pa.RecordBatch.from_arrays([*rows_of, *(pa.array(np.ascontiguousarray(values[:, i])) for i in range(2 * width))], ["row", "n", *columns])

    by_shard = dealt.withColumn("shard", F.pmod(F.shiftright("hash", 4), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", "hash", "classes")
    each = by_shard.select("shard", "classes").mapInArrow(run, "row long, n long, " + ", ".join(f"{c} float" for c in columns))
    mean = each.groupBy("row").agg(*[(F.sum(F.col(c).cast("double") * F.col("n")) / F.sum("n")).alias(c) for c in columns])
    out = np.c_[start.tables, start.adapted]
    for r in mean.collect():  # as many rows as the model has, whatever the corpus
        out[r[0]] = r[1:]
    return Model(*(np.ascontiguousarray(x) for x in (out[:, :width], out[:, width:])))


@dataclass
class Fitted:
    """A model with the counts it stands on; counted is the stored table of all words' counts."""

    known: Corpus
    counted: DataFrame
    model: Model


def _kind(classes: int) -> np.dtype:
    """What a class is stored as."""
    return np.min_scalar_type(classes - 1)


def coded(docs: DataFrame, known: Corpus) -> DataFrame:
    """Each text of marked() as its classes, the end's included, with its sums over what its task knows, and the words it must
    look up: row, doc_id, held_out, hash, n_tokens, n_known, base, shares, classes, rest; stored."""
    half_end, texts_known, mass = math.log10(known.texts + 0.5), int(known.texts > 0), known.class_mass()
    given = docs.sparkSession.sparkContext.broadcast((known.head, known.own, len(known.by_ending), known.counts, mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own_words, endings, counts, mass = given.value
        index, logs = Classes(head, own_words, endings), np.r_[np.log10(counts + 0.5), 0]  # 0: not in the head
        within = np.r_[np.zeros(own_words + 1), -np.log10(mass[own_words + 1 :])]
        row = TaskContext.get().partitionId() << 33
        for b in _slices(batches, "text"):
            words, lengths = words_of(b.column("text"))
            places = index.places(words)
            own, others = index.of(words, places), np.flatnonzero(places < 0)
            upto = np.cumsum(lengths + 1)
            inside = np.ones(upto[-1], bool)
            inside[upto - 1] = False  # the texts' ends
            classes = np.zeros(len(inside), _kind(len(mass)))
            classes[inside] = own
            values = np.zeros((3, len(inside)))  # an end adds nothing here
            values[:, inside] = places >= 0, logs[places], within[own] + np.where(places >= own_words, logs[places], 0)
            n_known, base, shares = np.add.reduceat(values, upto - lengths - 1, axis=1)
            text = np.repeat(np.arange(len(lengths)), lengths)[others]
            rest = pa.table({"text": text, "word": words.take(pa.array(others))}).group_by(["text", "word"], use_threads=False).aggregate([([], "count_all")]).sort_by("text")
            rest_words = pa.StructArray.from_arrays([rest.column(c).combine_chunks() for c in ("word", "count_all")], ["word", "n"])
            rest_upto = np.searchsorted(rest.column("text").to_numpy(), np.arange(len(lengths) + 1)).astype(np.int32)
            bytes_upto = (np.r_[0, upto] * classes.itemsize).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(b.num_rows)), *(b.column(c) for c in ("doc_id", "held_out", "hash")), pa.array(lengths + 1),
                    pa.array(n_known.astype(np.int64) + texts_known), pa.array(base + half_end), pa.array(shares),
                    pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(bytes_upto), pa.py_buffer(classes)]), pa.ListArray.from_arrays(pa.array(rest_upto), rest_words),
                ],
                ["row", "doc_id", "held_out", "hash", "n_tokens", "n_known", "base", "shares", "classes", "rest"],
            )
            row += b.num_rows

    schema = "row long, doc_id long, held_out boolean, hash long, n_tokens long, n_known long, base double, shares double, classes binary, rest array<struct<word:binary,n:long>>"
    # The id is part of the hash, so that it deals copies of a text to many shards.
    return stored(docs.select("doc_id", "text", "held_out", F.xxhash64("doc_id", "text").alias("hash")).mapInArrow(run, schema))


def _learned(training: DataFrame, known: Corpus, width: int, shard: int) -> Model:
    """The model of the texts that coded() has made."""
    mass = known.class_mass()
    model = Model.start(mass, width)
    if known.texts:
        part = F.pmod(F.col("hash"), F.lit(ROUNDS[-1]))
        for first, last in zip((0, *ROUNDS), ROUNDS, strict=False):
            shards = max(1, round(known.tokens * (last - first) / ROUNDS[-1] / shard))
            model = trained(training.where((part >= first) & (part < last)).select("hash", "classes"), model, shards, mass)
    return model


def fit(training: DataFrame, head: int = HEAD, endings: int = ENDINGS, width: int = WIDTH, shard: int = SHARD) -> Fitted:
    """The model of the texts that marked() has made. The same rows give the same model, however they are partitioned, up to
    the order in which Spark adds floating-point numbers."""
    counted = word_counts(training)
    known = corpus(training, counted, head, endings)
    return Fitted(known, counted, _learned(coded(training, known), known, width, shard))


def _scored(texts: DataFrame, fitted: Fitted) -> DataFrame:
    """coded() texts with their score by the model, without the words that must be looked up."""
    given = texts.sparkSession.sparkContext.broadcast(fitted.model.log_tables())
    columns = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, bias, norm = given.value
        k = len(bias)
        for b in _slices(batches, "classes", CODED):
            upto = np.cumsum(b.column("n_tokens").to_numpy())
            starts = np.r_[0, upto[:-1]]
            v, u, w = _context(np.frombuffer(b"".join(b.column("classes").to_pylist()), _kind(k)).astype(np.int64), starts)
            logs = one.ravel().take(v * k + w).astype(np.float64) + two.ravel().take(u * k + w) + bias[w] - norm.ravel().take(v * k + u)
            score = np.add.reduceat(logs, starts) / math.log(10) + b.column("shares").to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(score)], [*columns, "model"])

    return texts.select(*columns, "shares", "classes").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double")


def scores(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """The columns of lm_scores for docs, which marked() has made."""
    return _scores(coded(docs, fitted.known), fitted)


def _scores(texts: DataFrame, fitted: Fitted) -> DataFrame:
    known = fitted.known
    rest = texts.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.n")
    found = rest.join(fitted.counted.select("word", F.col("n").alias("c")), "word", "left")
    logs = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    sums = found.groupBy("row").agg(F.sum(F.col("n") * logs).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"))
    logs = F.coalesce("logs", F.lit(0.0))
    base = F.col("base") + logs - F.col("n_tokens") * F.lit(math.log10(known.base_mass))
    score = F.col("model") + logs if known.texts else base
    out = _scored(texts, fitted).join(sums, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def lm_scores(docs: DataFrame, head: int = HEAD, endings: int = ENDINGS, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    score is the model's log10 probability of the text, normalised over all words and one unknown one of each ending. Trained
    on all texts that are not held out. Null or empty text: its end alone. Repeated rows each give a row; a null doc_id stays
    null (its text trains); other columns are left behind. Very long texts and words are whole. Empty table: no rows. Without
    any training text score is base_score.
    """
    docs = marked(docs)
    training = docs.where(~F.col("held_out"))
    counted = word_counts(training)
    known = corpus(training, counted, head, endings)
    texts = coded(docs, known)  # once, for training and scores
    return _scores(texts, Fitted(known, counted, _learned(texts.where(~F.col("held_out")), known, width, shard)))
