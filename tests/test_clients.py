"""Statuses, revocations and attempts: odd rows, ties, losses."""

import itertools
from types import SimpleNamespace

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillspark.operators import devices as D
from quillspark.streaming import attempts as A
from quillspark.streaming.events import scratch

PATCH = "device long, at long, fields map<string,string>, extra string"


def test_the_last_patch_that_has_a_field_counts(spark):
    rows = [(1, 5, {"a": "x"}, ""), (1, 9, {"a": None}, ""), (1, 7, {"b": "y", "z": "?"}, ""), (2, 1, {"a": "p"}, ""), (2, 1, {"a": "q"}, ""), (3, 1, None, ""), (None, 1, {"a": "n"}, ""), (4, None, {"a": "n"}, "")]
    out = D.patched(spark.createDataFrame(rows, PATCH), {"a": "0", "b": None, "c": "d"}).orderBy("device").collect()
    assert [tuple(r) for r in out] == [(1, None, "y", "d"), (2, "q", None, "d"), (3, "0", None, "d")]
    assert D.patched(spark.createDataFrame([], PATCH), {"a": "0"}).count() == 0


def test_only_the_own_organization_revokes(spark):
    devices = spark.createDataFrame([(1, 10, "h", "s", None, None), (2, 10, "h", "s", 3, "old"), (None, 10, "h", "s", None, None)], "device long, organization long, refresh_token_hash string, session_id string, revoked_at long, revoked_reason string")
    requests = spark.createDataFrame([(1, 1, 10, 5, "a"), (2, 1, 10, 5, "b"), (3, 1, 11, 9, "other"), (4, 2, None, 9, "x"), (5, 7, 10, 9, None), (6, 1, 10, 1, "r" * 2000), (7, None, 10, 1, None)], "request long, device long, organization long, at long, reason string")
    assert {r.request: r.status for r in D.revocations(devices, requests).collect()} == {1: "revoked", 2: "revoked", 3: "not_found", 4: "not_found", 5: "not_found", 6: "revoked", 7: "not_found"}
    out = {r.device: r for r in D.revoked(devices, requests).collect()}
    assert len(out) == 3 and (out[1].revoked_at, out[1].revoked_reason, out[1].session_id, out[1].refresh_token_hash) == (5, "b", None, None)
    assert (out[2].revoked_at, out[2].revoked_reason, out[2].session_id) == (3, "old", "s")
    long = D.revoked(devices, requests.where("request = 6")).where("device = 1").first()
    none = D.revoked(devices, requests.where("request = 6").withColumn("reason", F.lit(""))).where("device = 1").first()
    assert (len(long.revoked_reason), none.revoked_reason) == (1000, "revoked by administrator")


def test_attempts_that_end_fail_or_are_lost(spark):
    log = scratch(spark)

    def work(what):
        def run(batch, number):
            if isinstance(what, BaseException):
                raise what
            return what

        return run

    def attempt(query, batch, what):
        try:
            A.logged(work(what), log, query, "w1")(None, batch)
        except BaseException as e:
            assert e is what

    attempt("q", 0, ValueError("x" * 3000))
    attempt("q", 0, KeyboardInterrupt())
    attempt("q", 0, 7)
    for _ in range(4):
        attempt("q", 1, OSError("gone"))
    attempt("q", 1, SystemExit())
    attempt("other", 0, None)
    rows = A.attempts(spark, log).orderBy("query", "batch", "attempt_number").collect()
    assert [(r.query, r.batch, r.attempt_number, r.outcome, r.error_type, r.result, r.recovered) for r in rows] == [
        ("other", 0, 1, "succeeded", None, None, False), ("q", 0, 1, "failed", "ValueError", None, False), ("q", 0, 2, "lost", None, None, False), ("q", 0, 3, "succeeded", None, 7, True),
        *(("q", 1, k, "failed", "OSError", None, False) for k in (1, 2, 3, 4)), ("q", 1, 5, "running", None, None, False),
    ]
    assert len(rows[1].error_summary) == 2000 and all(r.duration_ms >= 0 for r in rows if r.outcome in ("failed", "succeeded")) and rows[2].duration_ms is None
    assert {r.query: (r.failures, r.healthy, r.last_error_type) for r in A.health(A.attempts(spark, log)).collect()} == {"q": (4, True, "OSError"), "other": (0, True, None)}
    attempt("q", 1, OSError("again"))  # the one without an end was lost
    assert A.health(A.attempts(spark, log).where("query = 'q'")).first()[:3] == ("q", 6, False)


def test_attempts_of_one_millisecond_keep_their_order(spark, monkeypatch):
    log, now = scratch(spark), itertools.count(1_700_000_000_000_000_000)
    monkeypatch.setattr(A, "time", SimpleNamespace(time_ns=lambda: next(now)))
    for k in range(12):
        A.logged(lambda batch, number, k=k: k, log, "q")(None, 0)
    rows = A.attempts(spark, log).orderBy("attempt_number").collect()
    assert len({r.started_at for r in rows}) == 1 and [r.result for r in rows] == list(range(12))


def test_a_stream_that_never_succeeds_raises_in_the_end(spark):
    log, folder = scratch(spark), scratch(spark)
    spark.range(3).write.parquet(f"{folder}/rows")

    def work(batch, number):
        raise RuntimeError("no")

    stream = lambda: spark.readStream.schema("id long").parquet(f"{folder}/rows").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/check").foreachBatch(A.logged(work, log, "never"))
    with pytest.raises(StreamingQueryException):
        A.persevering(stream, 2)
    assert [(r.outcome, r.error_type) for r in A.attempts(spark, log).collect()] == [("failed", "RuntimeError")] * 2
