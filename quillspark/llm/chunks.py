"""Pre-tokens of byte-level vocabularies: a text is cut at white space into chunks that encode independently."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Unicode White_Space, as the Rust tokenizers understand \s (Python's own \s also has U+001C to U+001F).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: A run of other characters with one space before it; else white space, of which the last stays for the next chunk.
#: A pre-token never reaches over the end of such a run, so chunks and pre-tokens give the same tokens.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: Only white space chunks and words without any: for vocabularies that drop white space.
WORD = re.compile(f"[^{WHITE}]+")


def pattern(public: str):
    """The public pre-token pattern, compiled, with \\s spelled out."""
    import regex

    return regex.compile(public.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]"))


#: Texts with one of these take the pattern.
UNEVEN = ("  ", "\n\n", " \n", "\n ", *"\t\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))


class Memo(dict):
    """A function's results by argument: at most `most`, and none for strings of over 64 characters; others are computed each time."""

    def __init__(self, encode: Callable[[str], object], most: int = 400_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, chunk: str):
        out = self.encode(chunk)
        if len(self) < self.most and not (isinstance(chunk, str) and len(chunk) > 64):
            self[chunk] = out
        return out


class Chunks:
    """Encoded forms of a text's chunks, in order."""

    def __init__(self, encode: Callable[[str], object], most: int = 400_000):
        self.cut = Memo(encode)
        #: keys without the space that stands before a chunk: those that begin with a line break have none.
        self.spaced = Memo(lambda key: self.cut.encode(key if key[0] == "\n" else f" {key}"), most)

    def __call__(self, text: str) -> list:
        if not text:
            return []
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in UNEVEN):
            return [*map(self.cut.__getitem__, CHUNK.findall(text))]
        # Single spaces and line breaks only, so that split() gives the chunks, faster than the pattern.
        first, *rest = text.replace("\n", " \n").split(" ")
        return [self.cut[first], *map(self.spaced.__getitem__, rest)]


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]
