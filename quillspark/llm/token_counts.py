"""Operator 7: token counts by rank-synchronous array merging.

A batch's new words are held as one ragged array of symbols. Each round finds every word's pair of lowest rank
and merges it in all words at once; words without a mergeable pair leave. What is left counts as tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import WORD, byte_letters, pattern
from .common import texts

VOCABULARY = "word_bpe_49k.json"
#: Tokens that a document may have before it counts as over the limit.
LIMIT = 2048


class Counter:
    """Counts of a BPE vocabulary with word ends, whose normaliser lower-cases and drops white space."""

    def __init__(self, vocabulary: str = VOCABULARY, most: int = 600_000):
        import public_tokenizers as public

        with open(public.path(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]], np.int64)
        self.base = len(ids)
        key = pairs[:, 0] * self.base + pairs[:, 1]
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order, pairs[order, 2]
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int64)
        self.final = np.array([ids[x + model["end_of_word_suffix"]] for x in letters], np.int64)
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or "(?!)")
        self.split = pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.memo: dict[str, int] = {}
        self.most = most

    def merged(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word (none is empty)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        last = np.cumsum(size) - 1
        symbol[last] = self.final[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        left = size.copy()
        while len(symbol) > 1:
            key = symbol[:-1] * self.base + symbol[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.where((self.key[at] == key) & (word[:-1] == word[1:]), self.rank[at], len(self.key))
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, len(self.key)], starts)
            lowest = np.repeat(lowest, np.diff(np.r_[starts, len(symbol)]))
            merge = (rank == lowest[:-1]) & (rank < len(self.key))
            if not merge.any():
                break
            # Of pairs that overlap (one symbol three times) the first, third, ... merge, as from the left.
            spot = np.flatnonzero(merge)
            run = np.flatnonzero(np.r_[True, np.diff(spot) > 1])
            spot = spot[(np.arange(len(spot)) - np.repeat(run, np.diff(np.r_[run, len(spot)]))) % 2 == 0]
            symbol[spot] = self.made[at[spot]]
            keep = lowest < len(self.key)
            keep[spot + 1] = False
            np.subtract.at(left, word[spot], 1)
            symbol, word = symbol[keep], word[keep]
        return left

    def count_words(self, words: set[str]) -> dict[str, int]:
        """Tokens of runs of characters other than white space; those seen for the first time are merged together."""
        out, new = {}, []
        for w in words:
            known = self.memo.get(w)
            if known is None:
                new.append(w)
            else:
                out[w] = known
        pieces = [[p.encode() for p in self.split.findall(w)] for w in new]
        flat = sorted({p for ps in pieces for p in ps})
        found = {}
        for i in range(0, len(flat), 50_000):
            part = flat[i : i + 50_000]
            found.update(zip(part, self.merged(part).tolist(), strict=True))
        for w, ps in zip(new, pieces, strict=True):
            out[w] = n = sum(map(found.__getitem__, ps))
            if len(self.memo) < self.most and len(w) <= 64:
                self.memo[w] = n
        return out

    def count(self, batch: list[str]) -> list[int]:
        totals, words = [], []
        for text in batch:
            cut = self.special.split(text)
            totals.append(len(cut) - 1)  # a special string inside a text is one token
            text = " ".join(x if x.isascii() else unicodedata.normalize("NFC", x).replace("Σ", "σ") for x in cut)
            words.append(WORD.findall(text.lower()))
        counts = self.count_words(set().union(*words))
        return [n + sum(map(counts.__getitem__, ws)) for n, ws in zip(totals, words, strict=True)]


@cache
def counter(vocabulary: str = VOCABULARY) -> Counter:
    """One in each worker process."""
    return Counter(vocabulary)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of each whole text.

    Null or empty text: 0 and false. Repeated rows each give a row; a null doc_id stays null; other columns are left behind.
    Texts and words of any length are counted whole. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                batch = part.column(1).to_pylist()
                tokens = c.count(batch)
                columns = [part.column(0), pa.array([len(t.encode()) for t in batch], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
