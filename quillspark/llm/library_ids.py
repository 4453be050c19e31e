"""Whole texts to ids with the tokenizers library, chunk by chunk; the library's model encodes each chunk that is not in memory."""

from __future__ import annotations

import json
import os
import struct
from codecs import charmap_decode
from functools import cache

from .chunks import Chunks, Memo, byte_letters, pattern

VOCABULARY = "byte_bpe_50k.json"
#: Chunks that a worker process remembers; with their pieces about 60 MB.
MOST = 260_000
#: Marks that no letter or digit pattern takes in.
MARKS = (".", ",", ";", ":", "!", "?")


class LibraryIds:
    """ids as little-endian unsigned 32-bit integers, as Tokenizer.encode(text, add_special_tokens=False) gives them."""

    def __init__(self, vocabulary: str = VOCABULARY, most: int = MOST):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
        import public_tokenizers as public
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public.path(vocabulary))
        with open(public.path(vocabulary), encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.split, self.letters = pattern(public.PATTERN), "".join(byte_letters())
        self.model = self.library.model
        self.pieces = Memo(self._piece, most * 5 // 8)  # fewer than chunks: a word is one piece, whatever stands behind it
        self.chunks = Chunks(self._chunk, most)

    def _piece(self, piece: str) -> bytes:
        word = charmap_decode(piece.encode(), "strict", self.letters)[0]  # by byte, from the table
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        pieces = self.pieces
        if chunk.isascii():  # letters, and letters before one mark, are cut without the pattern
            word = chunk.removeprefix(" ")
            if word.isalpha():
                return pieces[chunk]
            if word[-1:] in MARKS and word[:-1].isalpha():
                return pieces[chunk[:-1]] + pieces[chunk[-1]]
        return b"".join([pieces[x] for x in self.split.findall(chunk)])

    def _plain(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):  # the library cuts such a text before it looks for white space
            return self._plain(text)
        return b"".join(self.chunks(text))


@cache
def library_ids(vocabulary: str = VOCABULARY, most: int = MOST) -> LibraryIds:
    """One in each worker process."""
    return LibraryIds(vocabulary, most)
