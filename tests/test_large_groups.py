"""Keys that hold many rows are folded batch by batch or dealt out."""

from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import identity, numbering
from quillspark.plans import catalogue, operations


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def whole_groups(df) -> bool:
    return "FlatMapGroups" in df._jdf.queryExecution().executedPlan().toString()


def test_rate_limits_carry_over_batches(spark, tmp_path, small_batches):
    rows = [(i, None if i % 5 == 4 else i % 2, datetime(2024, 1, 1) + timedelta(hours=(i * 37) % 900)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").repartition(3).write.parquet(f"file://{tmp_path}/events.parquet")
    out = catalogue.QUERIES["rate_limit_decisions"](spark, f"file://{tmp_path}")
    assert not whole_groups(out)
    want = Counter()
    for user in (0, 1, None):
        admitted = []
        for at, i in sorted((t, i) for i, u, t in rows if u == user):
            ok = sum(t >= at - timedelta(days=1) for t in admitted) < 2
            admitted += [at] if ok else []
            want[i, user, ok] += 1
    assert Counter(map(tuple, out.collect())) == want
    assert operations._limit(pd.DataFrame({"event_id": [1, 2, 3], "user_id": 7, "at": [0, 10, 70]}), 60, 1)["allowed"].tolist() == [True, False, True]


def test_conversations_carry_over_batches(spark, small_batches):
    rows = [(c, "user", None, k % 40, "complete", 1000 * k + c, f"d{k % 40}", f"{c}-{k}") for c in (1, 2) for k in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, role string, source_id string, seq long, status string, arrival long, digest string, fingerprint string")
    out = identity.three_layer(df, df)
    assert not whole_groups(out)
    assert Counter((r.conv_id, r.captures, r.identical, r.versions) for r in out.collect()) == {(1, 3, 2, 1): 40, (2, 3, 2, 1): 40}


def test_places_of_distant_ids_are_dealt_out(spark):
    """Ids as far apart as hashes; a group with most of the rows, and a null one."""
    ids = F.xxhash64(F.col("id")).alias("key")
    df = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 < 8, "most").otherwise("rest").alias("kind"), ids)
    out = numbering.numbered(df, "kind", "key")
    want = Counter()
    for kind in ("most", "rest", None):
        own = sorted(r.key for r in df.collect() if r.kind == kind)
        want.update((kind, key, n) for n, key in enumerate(own))
    assert Counter(map(tuple, out.select("kind", "key", "number").collect())) == want
    placed = numbering.placed(df, F.desc("key"))
    assert [r.key for r in sorted(placed.collect(), key=lambda r: r.place)] == sorted((r.key for r in df.collect()), reverse=True)
    files = [spark.read.parquet(name).count() for name in set(placed.inputFiles())]
    assert len(files) == 4 and max(files) < 2000  # one task's rows are a range of all
    assert numbering.numbered(df.where("false"), "kind", "key").count() == 0
