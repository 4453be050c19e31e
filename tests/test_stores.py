"""Tables that grow: conditional changes, states that merge, snapshots, claims and archives that survive faults between their steps."""

import random
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import admission, conversations, snapshots
from quillspark.sources.keyed import Keyed, Overtaken
from quillspark.streaming import archive
from quillspark.streaming.events import scratch

COUNTS = "key string, n bigint"


def keyed(spark, schema=COUNTS, key="key", **more):
    return Keyed(spark, scratch(spark), schema, key, **more)


def added(store, rows):
    """Add to each key's number."""
    new = store.spark.createDataFrame(rows, COUNTS)
    return store.change(lambda now: now.unionByName(new).groupBy("key").agg(F.sum("n").alias("n")), new)


def contents(store):
    return {r.key: r.n for r in store.read().collect()}


def test_changes_follow_each_other_and_old_ones_stay_readable(spark):
    store = keyed(spark)
    assert (contents(store), store.head()) == ({}, (0, {"folders": {}, "batches": {}}))
    assert added(store, [("a", 1), ("b", 2)]) == 1
    _, before = store.head()
    assert added(store, [("b", 5), (None, 7)]) == 2
    assert contents(store) == {"a": 1, "b": 7, None: 7}
    assert {r.key: r.n for r in store.read(document=before).collect()} == {"a": 1, "b": 2}
    assert Keyed(spark, store.base, COUNTS, "key").head()[0] == 2


def test_only_touched_buckets_are_read_and_written(spark):
    store = keyed(spark, buckets=8)
    added(store, [(f"k{i}", 1) for i in range(64)])
    _, before = store.head()
    seen = []
    new = spark.createDataFrame([("k3", 1)], COUNTS)
    [bucket] = store.touched(new)
    store.change(lambda now: seen.append(now) or now.unionByName(new).groupBy("key").agg(F.sum("n").alias("n")), new)
    assert {name.split("_bucket=")[1].split("/")[0] for name in seen[0].inputFiles()} == {str(bucket)}
    _, after = store.head()
    assert [b for b in after["folders"] if after["folders"][b] != before["folders"][b]] == [str(bucket)]
    assert contents(store)["k3"] == 2 and len(contents(store)) == 64


def test_a_taken_number_is_not_taken_again(spark):
    store = keyed(spark)
    assert store.commit(1, {"folders": {}, "batches": {"x": 1}}) and not store.commit(1, {"folders": {}, "batches": {"x": 2}})
    assert store.head()[1]["batches"] == {"x": 1}


def test_overtaken_writers_try_again_on_top(spark):
    store, done = keyed(spark), []
    new = spark.createDataFrame([("a", 1)], COUNTS)

    def make(now):
        if len(done) < 2:  # another writer comes first, twice
            done.append(added(store, [("a", 10)]))
        return now.unionByName(new).groupBy("key").agg(F.sum("n").alias("n"))

    assert store.change(make, new) == 3 and contents(store) == {"a": 21}
    with pytest.raises(Overtaken):
        store.change(lambda now: added(store, [("a", 0)]) and now, new)


def test_writers_at_once_lose_nothing(spark):
    store = keyed(spark, buckets=2)
    writers = [threading.Thread(target=added, args=(store, [(f"k{k % 2}", 1)])) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert contents(store) == {"k0": 2, "k1": 2} and store.head()[0] == 4


def test_a_batch_is_applied_once(spark):
    store = keyed(spark)
    new = spark.createDataFrame([("a", 1)], COUNTS)
    assert [store.change(lambda now: new, new, append=True, batch=("s", n)) for n in (0, 0, 1, 0)] == [1, 1, 2, 2]
    assert store.read().count() == 2


def captures(seed, n=60):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice([*x, None, ""])
    return [
        (rng.choice("abc"), at, pick(" T\t1 ", "T2"), pick("u1", "u2"), pick("m"), pick("p", "q"), rng.choice([*conversations.COMPLETENESS, "odd", None]), rng.choice([5, None]), rng.choice([7, 8, None]), rng.choice([*conversations.SOURCES, None]))
        for at in range(n)
    ]


def one_pass(rows):
    """The rules of an upsert, capture by capture."""
    out = {}
    for c, at, title, url, model, user, level, created, updated, source in sorted(rows, key=lambda r: r[1]):
        r = out.setdefault(c, {"title": None, "url": None, "model": None, "updated": None, "user": None, "created": created, "completeness": "unknown", "first_at": at, "sources": []})
        r["title"] = " ".join(title.split()) if title else r["title"]
        r["url"], r["model"], r["updated"], r["user"], r["last_at"] = url or r["url"], model or r["model"], updated or r["updated"], r["user"] or user or None, at
        levels = conversations.COMPLETENESS
        if level in levels and (level != levels[-1] or source == "compliance"):
            r["completeness"] = max(r["completeness"], level, key=levels.index)
        if source and source not in r["sources"]:
            r["sources"].append(source)
    return {c: r | {"sources": ",".join(r["sources"])} for c, r in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_states_merge_in_any_split(spark, seed):
    rows = captures(seed)
    of = lambda part: conversations.states(spark.createDataFrame(part, conversations.CAPTURE))
    shuffled = random.Random(seed).sample(rows, len(rows))
    parts = [shuffled[:7], shuffled[7:40], shuffled[40:], shuffled[:20]]
    for state in (conversations.merged(of(rows)), conversations.merged(conversations.merged(of(parts[0]), of(parts[1])), conversations.merged(of(parts[2])), of(parts[3]))):
        assert {r.conversation: {k: v for k, v in r.asDict().items() if k != "conversation"} for r in conversations.rows(state).collect()} == one_pass(rows)


def snapshot_store(spark):
    folder = scratch(spark)
    return Keyed(spark, f"{folder}/state", snapshots.STATE, "conv_id"), f"{folder}/objects"


def build(rows):
    return rows.select("conv_id", F.concat(F.lit("as of "), F.col("changed").cast("string")).alias("body"))


def test_snapshots_of_what_changes_meanwhile_stay_stale(spark):
    store, objects = snapshot_store(spark)
    arrive = lambda *rows: snapshots.arrived(store, spark.createDataFrame(rows, "conv_id long, arrival long"))
    state = lambda: {r.conv_id: (r.snapshot_version, r.covered, r.changed, r.body, r.verified) for r in snapshots.read_back(store, objects).collect()}
    arrive((1, 10), (1, 11), (2, 20))
    snapshots.write_snapshots(store, objects, build, lambda: arrive((2, 25), (3, 30)))
    assert state() == {1: (1, 11, 11, "as of 11", True), 2: (1, 20, 25, "as of 20", True), 3: (0, -1, 30, None, False)}
    # Two writers of the same versions: the second to mark keeps the first one's.
    snapshots.write_snapshots(store, objects, build, lambda: snapshots.write_snapshots(store, objects, build))
    assert state() == {1: (1, 11, 11, "as of 11", True), 2: (2, 25, 25, "as of 25", True), 3: (1, 30, 30, "as of 30", True)}
    n = store.head()[0]
    snapshots.write_snapshots(store, objects, build)
    arrive((2, 1))  # a late one that changes nothing
    assert state()[2][:3] == (2, 25, 25) and store.head()[0] <= n + 2


def test_claims_outlive_batches(spark):
    store = keyed(spark, admission.CLAIM)
    given = lambda rows, *batch: sorted(map(tuple, admission.admitted(store, spark.createDataFrame(rows, admission.CLAIM), *batch).collect()), key=str)
    first = [("a", 1, "ra"), ("b", 2, "rb"), ("a", 3, "later"), (None, 4, "x")]
    want = sorted([("a", 1, "admitted", "ra"), ("b", 2, "admitted", "rb"), ("a", 3, "replayed", "ra"), (None, 4, None, None)], key=str)
    assert given(first) == want
    assert given([("a", 9, "new"), ("c", 8, "rc")], "s", 5) == [("a", 9, "replayed", "ra"), ("c", 8, "admitted", "rc")]
    assert given([("a", 9, "new"), ("c", 8, "rc")], "s", 5) == [("a", 9, "replayed", "ra"), ("c", 8, "admitted", "rc")]
    assert given(first) == want and store.read().count() == 3


@pytest.mark.parametrize("fault", ["objects written", "rows written"])
def test_archive_survives_faults_between_its_steps(spark, tmp_path, fault):
    rows = [(k, datetime(2024, 1, 1), k % 3) for k in range(40)]
    for k in range(0, 40, 10):
        spark.createDataFrame(rows[k : k + 10] + rows[max(k - 1, 0) : k], "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    folder = f"file://{tmp_path}/out"
    store = Keyed(spark, f"{folder}/pointers", archive.POINTER, "event_id")
    documents = lambda b: b.select("event_id", F.format_string("k/%d", "event_id").alias("object_key"), F.concat(F.lit("body "), F.col("event_id").cast("string")).alias("body"))
    failed = []

    def step(name):
        if name == fault and len(failed) < 2:
            failed.append(name)
            raise RuntimeError("lost")

    def run():
        stream = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        q = stream.writeStream.foreachBatch(archive.archiving(store, f"{folder}/objects", documents, step)).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    got = archive.archived(store, f"{folder}/objects").collect()
    assert sorted((r.event_id, r.body) for r in got) == [(k, f"body {k}") for k in range(40)] and failed == [fault] * 2
