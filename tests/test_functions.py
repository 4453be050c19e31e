"""Scalar functions and sources on small fixtures."""

import base64
import gzip
import hashlib
import hmac
import json
import struct
import zlib

from pyspark.sql import functions as F

from quillspark.functions import binary as B
from quillspark.functions import records as R
from quillspark.sources import pulls
from quillspark.sources.sinks import gzip_json_lines
from quillspark.streaming.events import drained


def values(spark, rows, kind, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_canonical_json(spark):
    assert values(spark, ['{"b": 1, "a": "é", "c": null}', "[1, 2]", "no", None], "string", R.canonical_json) == ['{"a":"\\u00e9","b":1,"c":null}', "[1,2]", None, None]


def test_config_version(spark):
    assert values(spark, ["x"], "string", R.config_version) == [1 + int(hashlib.sha256(b"x").hexdigest()[:8], 16) % 2_000_000_000]


def test_signature(spark):
    want = base64.urlsafe_b64encode(hmac.new(b"k", b"text", hashlib.sha256).digest()).rstrip(b"=").decode()
    assert values(spark, ["text", None], "string", R.signature("k")) == [want, None]


def test_addresses(spark):
    assert values(spark, ["10.0.0.1", " ::ffff:10.0.0.1", "2001:DB8:0:0:0:0:0:1", "999.1.1.1", "", None], "string", R.canonical_address) == ["10.0.0.1", "10.0.0.1", "2001:db8::1", None, None, None]


def test_times(spark):
    got = values(spark, ["2026-03-15T10:30:00Z", "2026-03-15T10:30:00+00:00", "1773570600", "1773570600000", "2026-03-15 10:30:00", "not a time", "", None], "string", lambda x: F.unix_seconds(R.parsed_time(x)))
    assert got == [1773570600] * 5 + [None] * 3


def test_versions(spark):
    [row] = spark.range(1).select(*[(R.version_key(F.lit(a)) < R.version_key(F.lit(b))).alias(f"c{i}") for i, (a, b) in enumerate([("1.2", "1.10"), ("1.2.3", "1.2.3"), ("1.0.0", "1.0.0.1"), ("x", "0.1")])]).collect()
    assert list(row) == [True, False, True, True]


def test_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "Api_Key": "s", "Text": "t"})], "x map<string,string>, y map<string,string>")
    [r] = df.select(R.merged(F.col("x"), F.col("y")).alias("m"), R.audit_details(F.col("y")).alias("a")).collect()
    assert r.m == {"a": "1", "b": "3", "Api_Key": "s", "Text": "t"} and r.a == {"b": "3", "Api_Key": "s"}


def test_urls(spark):
    urls = ["https://e.org/c/abcd-1234", "http://e.org/", "https://e.org.evil.net/", "junk", None, "https://e.org/x?conversation=12345678"]
    assert values(spark, urls, "string", lambda x: R.allowed_url(x, ["e.org"])) == [True, False, False, False, False, True]
    assert values(spark, urls, "string", R.conversation_of) == ["abcd-1234", None, None, None, None, "12345678"]


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"tEXt", b"Author\0me") + chunk(b"IEND", b"")
JPEG = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xe1\x00\x08Exif\0\0" + b"\xff\xda\x00\x02scan\xff\xd9"


def test_kinds_of_files(spark):
    data = [PNG, JPEG, b"%PDF-1.7", b"plain text \xc3\xa9", b"", None, b"\x00\x01\xff", ("a" + "é" * 40_000).encode()]
    assert values(spark, data, "binary", B.sniffed) == ["image/png", "image/jpeg", "application/pdf", "text/plain", "application/x-empty", "application/x-empty", "application/octet-stream", "text/plain"]
    df = spark.createDataFrame([("a.PNG", "image/png"), ("a.png", "image/jpeg"), ("a", "text/plain"), ("x.txt", "other")], "n string, k string")
    assert [r[0] for r in df.select(B.fits(F.col("n"), F.col("k"))).collect()] == [True, False, False, False]


def test_images_lose_their_metadata_only(spark):
    png, jpeg, other, none = values(spark, [PNG, JPEG, b"x", None], "binary", B.without_metadata)
    assert bytes(png) == PNG.replace(chunk(b"tEXt", b"Author\0me"), b"") and bytes(jpeg) == JPEG.replace(b"\xff\xe1\x00\x08Exif\0\0", b"") and bytes(other) == b"x" and none is None


def page(*items):
    return json.dumps({"cursor": "c", "items": items})


def test_pulled_pages(spark, tmp_path):
    event = lambda i, t, at="2026-03-15T10:30:00Z": {"id": i, "type": t, "created_at": at, "conversation_id": "c1"}
    (tmp_path / "1.json").write_text(page(event("evt-1", "conversation.message.created"), event("evt-2", "conversation.deleted"), {"type": "message"}, event("old", "message", "2026-03-15T09:00:00Z")))
    (tmp_path / "2.json").write_text(page(event("evt-1", "conversation.message.created"), event("evt-3", "purge.done"), event("late", "message", "2026-03-15T09:55:00Z")))
    got = {r.source_event_id: (r.kind, r.is_deletion) for r in pulls.pulled(spark, str(tmp_path), "2026-03-15T10:00:00Z", "2026-03-15T11:00:00Z").collect()}
    assert got == {"evt-1": ("message", False), "evt-2": ("deletion", True), "evt-3": ("deletion", False), "late": ("message", False)}
    known = spark.createDataFrame([("evt-1",)], "source_event_id string")
    assert pulls.pulled(spark, str(tmp_path), "2026-03-15T10:00:00Z", "2026-03-15T11:00:00Z", known).count() == 3
    streamed = drained(pulls.page_stream(spark, str(tmp_path)))
    assert sorted(r.source_event_id for r in streamed.collect()) == ["evt-1", "evt-2", "evt-3", "late", "old"]


def test_files_by_size(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 10)
    (tmp_path / "b.bin").write_bytes(b"x" * 1000)
    assert [r.path.rpartition("/")[2] for r in pulls.files(spark, str(tmp_path), 100).collect()] == ["a.bin"]
    assert sorted(r.length for r in pulls.heads(spark, str(tmp_path)).collect()) == [10, 1000]


def test_json_lines_are_the_same_bytes_each_time(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "b long, a string").coalesce(1)
    one, two = (gzip_json_lines(df, f"file://{tmp_path}/{k}", ["b", "a"]).collect()[0] for k in "xy")
    assert (one.records, one.sha256) == (2, two.sha256)
    data = (tmp_path / "x" / one.file).read_bytes()
    assert hashlib.sha256(data).hexdigest() == one.sha256 and gzip.decompress(data).decode().splitlines()[0] == '{"a": "\\u00e9", "b": 1}'


def test_log_entries_are_scrubbed_on_every_level(spark):
    deep = {"a": 1}
    for _ in range(9):
        deep = {"x": [deep]}
    entry = {"User": {"TOKEN": "t", "list": [{"Body": "b"}, "Bearer abc.def", 5, None]}, "title": ["x"], "deep": deep, "é": True}
    want = R.scrubbed_value(entry)
    assert want["User"] == {"TOKEN": "[REDACTED]", "list": [{"Body": "[CONTENT_SUPPRESSED]"}, "Bearer [REDACTED]", 5, None]} and want["title"] == "[CONTENT_SUPPRESSED]"
    assert want["deep"] == {"x": [{"x": [{"x": ["[TRUNCATED]"]}]}]}
    assert R.scrubbed_value({"title": "Bearer x1", "session": 1}, allow_content=True) == {"title": "Bearer [REDACTED]", "session": "[REDACTED]"}
    got = values(spark, [json.dumps(entry), "Bearer abc", None, '["eyJhbGciOiJI.eyJzdWIiOiIx.xxxxxxxxxx"]'], "string", R.scrubbed_entry)
    assert json.loads(got[0]) == want and got[1:] == ["Bearer [REDACTED]", None, '["[REDACTED_JWT]"]']


def test_signatures_of_long_and_short_keys(spark):
    for key in ("k", "x" * 64, "ü" * 70):
        texts = ["", "a", "日本語"]
        want = [base64.urlsafe_b64encode(hmac.new(key.encode(), t.encode(), hashlib.sha256).digest()).rstrip(b"=").decode() for t in texts]
        assert values(spark, [*texts, None], "string", R.signature(key)) == [*want, None]


def test_reads_stop_at_the_limit(spark, tmp_path):
    sizes = {"small": 99, "limit": 100, "over": 101, "large": 3_000_000}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(bytes(range(256)) * (n // 256) + bytes(n % 256))
    got = {r.path.rpartition("/")[2]: r for r in pulls.bounded(spark, f"file://{tmp_path}", 100).collect()}
    assert {k: (r.length, r.bytes_read, r.too_large) for k, r in got.items()} == {k: (n, min(n, 101), n > 100) for k, n in sizes.items()}
    assert {k: None if r.data is None else len(r.data) for k, r in got.items()} == {"small": 99, "limit": 100, "over": None, "large": None}
