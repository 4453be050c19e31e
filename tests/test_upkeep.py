"""Tables by key are compacted and their unused files deleted while others write and read."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import admission as A
from quillspark.sources.keyed import Keyed
from quillspark.streaming.events import scratch


@pytest.fixture
def store(spark):
    s = Keyed(spark, scratch(spark), "k long, v long", "k", buckets=2)
    for v in range(4):
        rows = numbers(spark, v)
        s.change(lambda now, rows=rows: rows, rows, append=True, batch=("b", v))
    return s


def numbers(spark, v, n=20):
    return spark.range(n).select(F.col("id").alias("k"), F.lit(v).cast("long").alias("v"))


def rows(store, document=None):
    return sorted(map(tuple, store.read(document=document).collect()))


def test_compaction_changes_no_row(spark, store):
    before, (n, old) = rows(store), store.head()
    assert store.compact(most=4) == [] and store.head()[0] == n
    assert store.compact(most=3) == [0, 1] and store.head()[0] == n + 1
    assert rows(store) == before == rows(store, old)
    assert all(len(own) == 1 for own in store.head()[1]["folders"].values()) and store.head()[1]["batches"] == {"b": 3}
    assert store.expire(kept=1) == 0  # all are younger than the grace
    assert store.expire(kept=2, grace=-60) == 0  # the change before still names them
    assert store.expire(kept=1, grace=-60) == 8 and rows(store) == before
    assert store.expire(kept=1, grace=-60) == 0


def test_what_others_write_meanwhile_stays(spark, store, monkeypatch):
    before, late, write = rows(store), numbers(spark, 9, 1), Keyed._write
    bucket = late.select(store.bucket()).first()[0]

    def during(self, made):
        monkeypatch.setattr(Keyed, "_write", write)
        done = write(self, made)
        self.change(lambda now: late, late, append=True)
        other = self.read([1 - bucket]).where("v = 0")
        self.change(lambda now: other, other)  # replaces the other bucket
        return done

    monkeypatch.setattr(Keyed, "_write", during)
    assert store.compact(most=3) == [bucket]
    own = {k for k, _ in rows_of(store, bucket)}
    assert rows(store) == sorted([r for r in before if r[0] in own or r[1] == 0] + [(0, 9)])
    assert len(store.head()[1]["folders"][str(bucket)]) == 2
    store.expire(kept=1, grace=-60)
    assert (0, 9) in rows(store)


def rows_of(store, bucket):
    return list(map(tuple, store.read([bucket]).collect()))


def test_an_empty_table_and_claims_after_upkeep(spark):
    empty = Keyed(spark, scratch(spark), "k long", "k")
    assert empty.compact() == [] and empty.expire(grace=-60) == 0
    claims = Keyed(spark, scratch(spark), A.CLAIM, "key", buckets=2)
    batch = lambda low, high: spark.range(low, high).select(F.col("id").cast("string").alias("key"), F.col("id").alias("arrival"), F.lit("r").alias("result"))
    for k in range(3):
        A.admitted(claims, batch(k * 5, k * 5 + 10), "s", k).count()
    assert claims.compact(most=2) == [0, 1]
    claims.expire(kept=1, grace=-60)
    again = A.admitted(claims, batch(0, 25).withColumn("arrival", F.col("arrival") + 100 * (F.col("arrival") < 20).cast("long")), "s", 3)
    assert {r.outcome: r["count"] for r in again.groupBy("outcome").count().collect()} == {"replayed": 20, "admitted": 5}
