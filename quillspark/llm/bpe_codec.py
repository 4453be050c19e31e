"""Operator 4: byte-level BPE encoding and decoding by prefix dynamic programming.

Every prefix of a pre-token has exactly one valid last token: the one whose pairing with the last token
of the shorter prefix is what BPE itself would leave. Storing it per prefix makes appends exact (old entries
never change) and lets an edit keep all entries before it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import Chunks, Memo, pattern
from .common import texts

VOCABULARY = "byte_bpe_50k.tiktoken"


class Ranks:
    """A rank file: token bytes <-> rank, and which two tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.bytes_of[rank] = token
        self.ends = {token[i:]: -1 for token in self.rank for i in range(len(token))} | self.rank
        self.halves = Memo(self._halves, len(self.rank))
        self.fits = Memo(self._fits, 1 << 19)

    def merged(self, data: bytes, parts_left: int = 1) -> list[bytes]:
        """BPE from its definition, for the few bytes of a token: merge the leftmost pair of lowest rank while there is one."""
        parts, none = [data[i : i + 1] for i in range(len(data))], len(self.bytes_of)
        while len(parts) > parts_left:
            best, i = min((self.rank.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if best == none:
                break
            parts[i : i + 2] = [self.bytes_of[best]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; () for a single byte, None for one that the merges don't reach (it occurs only as a whole pre-token)."""
        data = self.bytes_of[token]
        if len(data) == 1:
            return ()
        two = self.merged(data, 2)
        return (self.rank[two[0]], self.rank[two[1]]) if len(two) == 2 else None

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Would BPE leave this pair? Step back through the merges that made the two: before each, the tokens that then
        met in the middle must not have had a merge that comes earlier (of two equal ones the left comes first)."""
        left, right = pair
        before = len(self.bytes_of)
        while True:
            if self.rank.get(self.bytes_of[left] + self.bytes_of[right], before) < before:
                return False
            cut_left, cut_right = self.halves[left], self.halves[right]
            if cut_left and (left > right or not cut_right):
                before, left = left, cut_left[1]
            elif cut_right:
                before, right = right + 1, cut_right[0]
            else:
                return True


class PrefixTable:
    """The bytes of one pre-token with the valid last token of each prefix."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        data, last, ends, halves, fits = self.data, self.last, self.ranks.ends, self.ranks.halves, self.ranks.fits
        for end in range(start + 1, len(data) + 1):
            for begin in range(end - 1, -1, -1):
                token = ends[data[begin:end]]
                if token >= 0 and halves[token] is not None and (begin == 0 or fits[last[begin], token]):
                    last.append(token)
                    break

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Prefixes up to start keep their entries; what follows is encoded again."""
        rest = self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(data + rest)

    def tokens(self) -> list[int]:
        if self.data in self.ranks.rank:  # a whole pre-token that is in the vocabulary is that token
            return [self.ranks.rank[self.data]]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.ranks.bytes_of[self.last[end]])
        return out[::-1]


class Codec:
    """Whole texts to ids and back. ids are kept as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers as public

        self.ranks = Ranks(public.path(vocabulary))
        self.split = pattern(public.PATTERN)
        self.chunks = Chunks(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        ids = []
        for piece in self.split.findall(chunk):
            data = piece.encode()
            whole = self.ranks.rank.get(data)
            ids += PrefixTable(self.ranks, data).tokens() if whole is None else [whole]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(self.chunks(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, memoryview(ids).cast("I")))


@cache
def codec(vocabulary: str = VOCABULARY) -> Codec:
    """One in each worker process."""
    return Codec(vocabulary)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit) of each whole text.

    Null or empty text: no ids. Repeated rows each give a row; a null doc_id stays null; other columns are left behind. A long
    text is encoded whole, pre-token by pre-token. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(c.encode, b.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, data binary: the bytes that ids stand for. Null ids: no bytes. An id outside the vocabulary fails. Empty table: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((c.decode(x or b"") for x in b.column(1).to_pylist()), pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def codec_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encode, decode what was encoded, and digest both, text by text, so that neither form is ever stored.

    doc_id, n_tokens, ids_sha256, decoded_sha256. Nulls, repeats, other columns, long texts and an empty table as in encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                ids = c.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            n, one, two = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
