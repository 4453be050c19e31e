"""Functions over file bytes: what kind they are, what name fits, and images without their metadata."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

#: First bytes of a file, in hexadecimal, and the kind they tell; extensions that fit a kind.
MAGIC = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif", "474946383961": "image/gif", "25504446": "application/pdf", "504B0304": "application/zip", "1F8B": "application/gzip"}
EXTENSIONS = {"image/png": ["png"], "image/jpeg": ["jpg", "jpeg"], "image/gif": ["gif"], "application/pdf": ["pdf"], "application/zip": ["zip", "docx", "xlsx"], "application/gzip": ["gz"], "text/plain": ["txt", "md", "csv", "log"]}


def sniffed(data: Column) -> Column:
    """The kind of a file by its first bytes; text if its first 64 KiB are UTF-8 without NUL; else unknown."""
    head = F.hex(F.substring(data, 1, 16))
    out = F.when(F.coalesce(F.octet_length(data), F.lit(0)) == 0, "application/x-empty")
    for magic, kind in MAGIC.items():
        out = out.when(F.startswith(head, F.lit(magic)), kind)
    # A character that the cut splits has at most three bytes before it: one of four cuts is whole.
    sample = [F.substring(data, F.lit(1), F.greatest(F.least(F.octet_length(data), F.lit(1 << 16)) - k, F.lit(1))) for k in range(4)]
    long = F.octet_length(data) > (1 << 16)
    valid = [F.is_valid_utf8(x.cast("string")) for x in sample]
    text = valid[0] | (long & (valid[1] | valid[2] | valid[3]))
    return out.when(text & (F.instr(F.hex(sample[0]), "00") % 2 != 1), "text/plain").otherwise("application/octet-stream")


def fits(name: Column, kind: Column) -> Column:
    """Does a file's extension belong to its kind?"""
    table = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(table, kind), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))), F.lit(False))


def _jpeg(data: bytes) -> bytes:
    out, at = [data[:2]], 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xDA:  # the picture itself
            break
        size = 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        if mark not in (0xE1, 0xED, 0xFE):  # Exif and XMP, IPTC, comments
            out.append(data[at : at + size])
        at += size
    return b"".join([*out, data[at:]])


def _png(data: bytes) -> bytes:
    out, at = [data[:8]], 8
    while at + 12 <= len(data):
        size = 12 + struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] not in (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME"):
            out.append(data[at : at + size])
        at += size
    return b"".join(out)


@pandas_udf(BinaryType())
def without_metadata(data: pd.Series) -> pd.Series:
    """JPEG and PNG files without Exif, text and times; other bytes as they are."""

    def one(x):
        if x is None:
            return None
        return _jpeg(x) if x[:3] == b"\xff\xd8\xff" else _png(x) if x[:8] == b"\x89PNG\r\n\x1a\n" else x

    return data.map(one)
