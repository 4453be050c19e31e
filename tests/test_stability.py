"""Messages given out once they hold, against a simulation, whatever the order in which observations arrive."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import stability as S
from quillspark.streaming.events import drained

QUIET = 5_000


def observations(seed, conversations=4, n=60):
    rng, out = random.Random(seed), []
    for c in range(conversations):
        ms = 0
        for k in range(n):
            ms += rng.choice([0, 500, 1000, 4999, 5000, 5001, 9999, 10_000, 10_001, 23_000])
            out.append((f"c{c}", ms, k, f"m{rng.randrange(4)}", rng.choice("AAB"), rng.random() < 0.25, rng.random() < 0.12))
    return out


def simulated(rows, until):
    """A millisecond clock for each conversation: what is due at a time, after what is observed at it."""
    out = []
    for c in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == c)
        seen, tracked, looks = {}, {}, []
        times = sorted({ms for ms, *_ in own} | {ms + QUIET * k for ms, *_ in own for k in (1, 2)})
        for now in times:
            if now > until:
                break
            for ms, _, identity, signature, streaming, hidden in own:
                if ms != now:
                    continue
                if hidden:
                    out += [(c, m, t[0], "partial", now) for m, t in tracked.items() if not t[1]]
                    tracked = {m: (t[0], True) for m, t in tracked.items()}
                    looks = []
                else:
                    seen[identity], looks = (signature, streaming), [now + QUIET, now + 2 * QUIET]
            if looks and looks[0] == now:
                looks.pop(0)
                for m, (signature, streaming) in seen.items():
                    if m not in tracked or tracked[m][0] != signature:
                        tracked[m] = signature, False
                    elif not tracked[m][1] and not streaming:
                        tracked[m] = signature, True
                        out.append((c, m, signature, "complete", now))
    return sorted(out)


@pytest.mark.parametrize("seed", range(5))
def test_fold_equals_simulation_in_any_steps(seed):
    rows = observations(seed, conversations=1)
    for steps in ([10**9], sorted(random.Random(seed).sample(range(300_000), 20)) + [10**9]):
        messages, armed, looks, got, waiting = {}, None, 0, [], sorted(r[1:] for r in rows)
        for until in steps:
            own = S.Conversation(armed, looks)
            ready, waiting = [r for r in waiting if r[0] <= until], [r for r in waiting if r[0] > until]
            got += [("c0", *x) for x in own.fold(ready, messages, QUIET, until)]
            armed, looks = own.armed, own.looks
        assert sorted(got) == simulated(rows, 10**9)
    assert {x[3] for x in got} == ({"complete"} if seed == 2 else {"complete", "partial"})


@pytest.mark.parametrize("order", ["mixed", "one file"])
def test_stream_equals_simulation_whatever_the_order(spark, tmp_path, order):
    rows = [*observations(7), ("end", 10_000_000, 0, "m", "A", False, False)]
    start = datetime(2024, 1, 1, tzinfo=UTC)
    shuffled = random.Random(3).sample(rows[:-1], len(rows) - 1) + rows[-1:]
    groups = [rows] if order == "one file" else [shuffled[k : k + 70] for k in range(0, len(shuffled), 70)]
    for k, part in enumerate(groups):
        data = [(c, start + timedelta(milliseconds=ms), ms + int(start.timestamp() * 1000), *rest) for c, ms, *rest in part]
        spark.createDataFrame(data, S.OBSERVED).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(S.OBSERVED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in").withWatermark("at", "2 hours")
    with S.rocks(spark):
        got = drained(S.stable(stream, QUIET)).withColumn("ms", F.col("ms") - int(start.timestamp() * 1000)).collect()
    assert sorted(map(tuple, got)) == simulated(rows, 10_000_000 - 7_200_000 - 1)


def test_provider_is_put_back(spark):
    before = spark.conf.get(S._PROVIDER, None)
    with pytest.raises(ZeroDivisionError), S.rocks(spark):
        1 / 0
    assert spark.conf.get(S._PROVIDER, None) == before


def test_a_timer_moves_a_conversations_state_once():
    """Each call to a state is a message to the executor: their number must not grow with the observations."""
    calls = []

    class State:
        def __init__(self, value):
            self.value = value

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                return self.value

            return call

    own = S.Stability(QUIET)
    rows = [r[1:] for r in observations(1, conversations=1, n=500)]
    own.handle, own.waiting, own.held = State(None), State(rows), State(None)
    own.timer = State(10**9)
    given = list(own.handleExpiredTimer(("c0",), own.timer, None))
    assert len(calls) <= 6 and sorted(tuple(r) for r in given) == simulated([("c0", *r) for r in rows], 10**9)
