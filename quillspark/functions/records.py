"""Scalar functions over JSON, maps, times, versions and addresses."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .text import SCRUBS, scrubbed

#: Keys whose values are credentials, and keys whose values are what people wrote.
SENSITIVE_KEYS = (
    "authorization", "proxy-authorization", "cookie", "set-cookie", "password", "postgres_password", "secret", "client_secret",
    "api_key", "apikey", "access_token", "refresh_token", "id_token", "token", "jwt", "session",
    "aws_secret_access_key", "aws_access_key_id", "presigned_url", "upload_url", "download_url", "signature", "x-amz-signature", "code_verifier",
    "private_key",
)
CONTENT_KEYS = (
    "text", "content", "message", "body", "html", "sanitized_html", "plain_text", "parts",
    "payload", "raw_payload", "title", "prompt", "answer",
)


def scrubbed_map(fields: Column, allow_content: bool = False) -> Column:
    """Log fields: credentials and, unless allowed, content are masked by key, all else by pattern."""

    def one(key: Column, value: Column) -> Column:
        out = F.when(F.lower(key).isin(*SENSITIVE_KEYS), "[REDACTED]")
        return (out if allow_content else out.when(F.lower(key).isin(*CONTENT_KEYS), "[CONTENT_SUPPRESSED]")).otherwise(scrubbed(value))

    return F.transform_values(fields, one)


@pandas_udf(StringType())
def canonical_json(document: pd.Series) -> pd.Series:
    """Sorted keys, no spaces, ASCII with escapes: the form that digests are taken of. Invalid JSON gives null."""

    def one(text):
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return document.map(one)


def config_version(document: Column) -> Column:
    """1 plus the first 32 bits of a document's sha256, modulo two thousand million."""
    return (F.conv(F.substring(F.sha2(document, 256), 1, 8), 16, 10).cast("long") % 2_000_000_000 + 1).cast("long")


def signature(key: str):
    """HMAC-SHA256 of a string column under a key, URL-safe base64 without padding."""
    block = hashlib.sha256(key.encode()).digest() if len(key.encode()) > 64 else key.encode()
    inner, outer = (F.lit(bytes(x ^ pad for x in block.ljust(64, b"\0"))) for pad in (0x36, 0x5C))

    def sign(text: Column) -> Column:
        digest = F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256))
        return F.rtrim(F.translate(F.base64(digest), "+/", "-_"), F.lit("="))

    return sign


@pandas_udf(StringType())
def canonical_address(address: pd.Series) -> pd.Series:
    """The shortest form of an IP address, an IPv4 one in IPv6 as itself; null if it is none."""

    def one(text):
        try:
            found = ipaddress.ip_address((text or "").strip())
        except ValueError:
            return None
        return str(getattr(found, "ipv4_mapped", None) or found)

    return address.map(one)


def parsed_time(value: Column) -> Column:
    """A time from text: a number is seconds, or milliseconds above 1e11; else ISO, in UTC where it has no zone; else null."""
    number = F.try_to_number(value, F.lit("99999999999999999999")).cast("decimal(20,0)")
    seconds = F.when(number > F.lit(10**11), number / F.lit(1000)).otherwise(number).cast("double")
    zoned = F.when(value.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$"), value).otherwise(F.concat(value, F.lit("Z")))
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_timestamp(zoned))
    return F.when(value.rlike(r"^\d{1,20}$"), F.timestamp_seconds(seconds)).otherwise(iso)


def version_key(version: Column) -> Column:
    """An array that compares as versions do: numbers by number, missing or other parts as 0, four at most."""
    parts = F.transform(F.split(version, "[.+-]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)


def merged(base: Column, patch: Column) -> Column:
    """Two maps as one: where both have a key the patch's value stands."""
    return F.map_zip_with(F.coalesce(base, F.create_map().cast("map<string,string>")), F.coalesce(patch, F.create_map().cast("map<string,string>")), lambda k, x, y: F.coalesce(y, x))


#: Keys that an audit row's details never carry.
AUDIT_KEYS = ("text", "plain_text", "sanitized_html", "content", "payload", "body", "note", "title")


def audit_details(fields: Column) -> Column:
    """Without keys that carry content, in any case."""
    return F.map_filter(fields, lambda k, v: ~F.lower(k).isin(*AUDIT_KEYS))


#: Levels of a log entry below which it is cut, and what stands there.
DEEPEST, CUT = 6, "[TRUNCATED]"
_SCRUBS = tuple((re.compile(pattern), mark.replace("$1", r"\1")) for pattern, mark in SCRUBS)


def scrubbed_value(value, allow_content: bool = False, depth: int = 0):
    """A log entry of any shape: credentials and, unless allowed, content are masked by key on every level, all other text by pattern."""
    if depth > DEEPEST:
        return CUT
    if isinstance(value, str):
        for pattern, mark in _SCRUBS:
            value = pattern.sub(mark, value)
        return value
    if isinstance(value, dict):
        masks = {**({} if allow_content else dict.fromkeys(CONTENT_KEYS, "[CONTENT_SUPPRESSED]")), **dict.fromkeys(SENSITIVE_KEYS, "[REDACTED]")}
        return {k: masks[k.lower()] if k.lower() in masks else scrubbed_value(v, allow_content, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [scrubbed_value(v, allow_content, depth + 1) for v in value]
    return value


@pandas_udf(StringType())
def scrubbed_entry(document: pd.Series) -> pd.Series:
    """Log entries as JSON with sorted keys, scrubbed on every level and in lists; what isn't JSON is scrubbed as text."""

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(scrubbed_value(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return scrubbed_value(text)

    return document.map(one)


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """https and exactly one of these hosts."""
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(hosts), F.lit(False))


def conversation_of(url: Column) -> Column:
    """The conversation id in a URL: the first of its known places that has one."""
    places = (r"/c/([A-Za-z0-9-]{8,})", r"/share/([A-Za-z0-9-]{8,})", r"[?&]conversation=([A-Za-z0-9-]{8,})")
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in places])
