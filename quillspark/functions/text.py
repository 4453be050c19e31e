"""Scalar functions over text, as column expressions; Arrow functions only where the JVM has no equal."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
#: Field names that carry content or credentials, and never reach a log.
SECRET_KEYS = ("authorization", "cookie", "password", "secret", "token", "api_key")


@pandas_udf(StringType())
def normalise(text: pd.Series) -> pd.Series:
    """NFKC, white space to single spaces, stripped, case-folded."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def content_hash(text: Column) -> Column:
    return F.sha2(normalise(text), 256)


def fingerprint(conversation: Column, role: Column, digest: Column, sequence: Column, bucket: Column) -> Column:
    """sha256 over conversation, role, content hash, sequence in fives (-1 without one) and five-minute bucket."""
    step = F.coalesce(F.floor(sequence / 5), F.lit(-1)).cast("string")
    return F.sha2(F.concat_ws("|", conversation.cast("string"), F.lower(role), digest, step, bucket.cast("string")), 256)


def bucket(seconds: Column, width: int = 300) -> Column:
    """Start of the bucket that an epoch second lies in; 0 without one."""
    return F.coalesce(seconds - F.pmod(seconds, F.lit(width)), F.lit(0)).cast("long")


def pseudonym(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.lit("|"), F.lower(F.trim(value))), 256)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def cleaned(text: Column, most: int = 1_000_000) -> Column:
    """Without control characters, runs of spaces and tabs as one space, cut to `most` characters, stripped."""
    return F.btrim(F.substring(F.regexp_replace(F.regexp_replace(text, CONTROL, ""), r"[ \t]+", " "), 1, most), F.lit(" \t\n\r"))


@pandas_udf(StringType())
def decomposed(name: pd.Series) -> pd.Series:
    """NFKD, without what can't be printed."""
    return name.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if c.isprintable()))


def safe_filename(name: Column, longest: int = 128) -> Column:
    """The last path segment, decomposed, with runs of anything but ASCII letters, digits, dot, underscore and dash as underscores,
    and of at most `longest` characters with its extension."""
    last = decomposed(F.regexp_replace(F.regexp_replace(name, r"\\", "/"), r"(?s)^.*/", ""))
    ext = F.lower(F.regexp_extract(last, r"(\.[A-Za-z0-9]{1,10})$", 1))
    stem = F.regexp_replace(F.substring(last, F.lit(1), F.length(last) - F.length(ext)), r"[^A-Za-z0-9._-]", "_")
    stem = F.regexp_replace(F.regexp_replace(stem, r"\.{2,}", "."), r"^[._-]+|[._-]+$", "")
    whole = F.concat(F.substring(F.when(stem == "", F.lit("file")).otherwise(stem), F.lit(1), F.lit(longest) - F.length(ext)), ext)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("attachment.bin")).otherwise(whole)


def redacted(text: Column) -> Column:
    """Mail addresses, bearer values, keys, card-like numbers and addresses of machines masked, in that order."""
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"[Bb]earer [A-Za-z0-9._~+/-]+", "[BEARER]"),
    (r"(AKIA|sk-|ghp_)[A-Za-z0-9_-]{12,}", "[KEY]"),
    (r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "[NUMBER]"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[ADDRESS]"),
)


def split_bucket(key: Column) -> Column:
    """The first 32 bits of sha256 as a share of their largest value."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") / F.lit(4294967295)


def split_name(key: Column, ratios: dict[str, float]) -> Column:
    """The split of a key: cumulative shares over names in alphabetical order, each below its bound, the last for the rest."""
    if not ratios:
        return F.lit("train")
    names, bound, out = sorted(ratios), 0.0, None
    for name in names[:-1]:
        bound += ratios[name]
        case = split_bucket(key) < F.lit(bound)
        out = F.when(case, F.lit(name)) if out is None else out.when(case, F.lit(name))
    return F.lit(names[-1]) if out is None else out.otherwise(F.lit(names[-1]))


#: Fixed patterns: what a log line must not hold, and what stands there instead.
SCRUBS = (
    (r"(?i)bearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [REDACTED]"),
    (r"(?i)\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"(?i)(X-Amz-Signature=)[0-9a-f]+", "$1[REDACTED]"),
    (r"(?i)(X-Amz-Credential=)[^&\s]+", "$1[REDACTED]"),
    (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[REDACTED_JWT]"),
)


def scrubbed(text: Column) -> Column:
    """A log line without bearer values, access keys, parts of signed addresses and three-part tokens."""
    for pattern, mark in SCRUBS:
        text = F.regexp_replace(text, pattern, mark)
    return text
