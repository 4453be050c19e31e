"""Streams over tables whose files are many and in no order of time."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from quillspark.plans import catalogue
from quillspark.streaming import events

KINDS = ["view", "click", "error"]


@pytest.fixture(params=[1_000_000, 25, None])
def shuffled(spark, tmp_path, monkeypatch, request):
    """12 days of events in 20 files, dealt at random."""
    if request.param is None:  # a store that does not keep the times
        monkeypatch.setattr(events, "_in_order", lambda spark, folder: 1000)
    monkeypatch.setattr(events, "FILE_ROWS", request.param or 25)
    r = random.Random(3)
    rows = [(i, i % 7, KINDS[i % 3], datetime(2024, 1, 1) + timedelta(minutes=35 * i, seconds=i % 50), 1.0) for i in range(500)]
    r.shuffle(rows)
    for k in range(20):
        part = spark.createDataFrame(rows[25 * k : 25 * k + 25], "event_id long, user_id long, event_type string, ts timestamp_ntz, value double")
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
    return f"file://{tmp_path}", rows


def test_no_event_is_lost_by_the_order_of_files(spark, shuffled):
    folder, rows = shuffled
    got = catalogue.QUERIES["stream_dedupe"](spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(r[:3] for r in rows)
    start = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) // 3600 * 3600
    last = max(int((r[3] - datetime(1970, 1, 1)).total_seconds()) for r in rows) - 600
    want = Counter((start(r[3]), r[2]) for r in rows if start(r[3]) + 3600 <= last)
    assert Counter({(r.start, r.event_type): r.n for r in catalogue.QUERIES["stream_rate_windows"](spark, folder).collect()}) == want
