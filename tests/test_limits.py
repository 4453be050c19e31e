"""Four limiters against one plain pass over all requests."""

import random

import pytest

from quillspark.operators import limits as L

HITS = "request long, at long, cost int, user string, device string, address string"


def requests(seed, n=400, span=3000):
    rng = random.Random(seed)
    times = sorted(rng.choice([rng.randrange(span), rng.randrange(span // 60) * 60]) * L.SECOND + rng.choice([0, 0, 1, 999_999]) for _ in range(n))
    return [(k, t, rng.choice([1, 1, 1, 2]), rng.choice(["a", "a", "a", "b", None, ""]), rng.choice(["x", "y", None]), rng.choice(["1", "2", "2"])) for k, t in enumerate(times)]


def plain(rows, limiters):
    """Every request in order of time, every limiter's admitted times in a list."""
    admitted, out = {}, {}
    for request, at, cost, *keys in sorted(rows, key=lambda r: (r[1], r[0])):
        found = []
        for s, key in zip(limiters, (keys[0], keys[0], keys[1], keys[2]), strict=True):
            if not key:
                continue
            own = admitted.setdefault((s.name, key), [])
            inside = [t for t in own if t >= at - s.window]
            if len(inside) + cost <= s.limit:
                own += [at] * cost
                found.append((True, s.limit - len(inside) - cost, 0, s))
            else:
                oldest = inside[0] if inside else at
                found.append((False, 0, max(1, int((s.window - (at - oldest)) / L.SECOND) + 1), s))
        denied = [x for x in found if not x[0]]
        worst = max(denied, key=lambda x: x[2]) if denied else min(found, key=lambda x: x[1]) if found else (True, None, None, None)
        out[request] = (*worst[:3], worst[3] and worst[3].name, worst[3] and worst[3].limit)
    return out


@pytest.mark.parametrize(("seed", "slices"), [(1, 1), (2, 3), (3, 256)])
def test_decisions_equal_one_pass(spark, seed, slices):
    rows = requests(seed) + [(1000, 5, 1, None, None, None), (1001, 10**12, 1, "a", "x", "1")]
    limiters = L.scopes(per_minute=9, burst=6, workers=3)
    got = L.decisions(spark.createDataFrame(rows, HITS).repartition(5), limiters, slices).collect()
    assert {r.request: tuple(r)[1:] for r in got} == plain(rows, limiters) and len(got) == len(rows)
    assert {r.scope for r in got} == {"user", "burst", "device", "address", None} and {r.allowed for r in got} == {True, False}


@pytest.mark.parametrize("slices", [1, 4, 256])
def test_pieces_are_cut_where_a_key_is_idle(spark, slices):
    """One key with most rows falls into as many pieces as it has gaps, and into no more."""
    rows = [(k, (k // 10 * 100 + k % 10) * L.SECOND, 1, "a", None, None) for k in range(600)]
    user, *_ = limiters = L.scopes(per_minute=3, burst=2)
    got = L.pieces(spark.createDataFrame(rows, HITS), limiters, slices).collect()
    assert {(r.request, r.piece // L.SECOND) for r in got if r.scope == 0} == {(k, k // 10 * 100 if k // 10 else 0) for k in range(600)}
    assert user.window == 60 * L.SECOND and sum(r.scope == 1 for r in got) == 600
    dense = [(k, k * 30 * L.SECOND, 1, "a", None, None) for k in range(300)]
    assert {r.piece for r in L.pieces(spark.createDataFrame(dense, HITS), limiters, slices).collect() if r.scope == 0} == {0}


def test_budgets_are_shared_by_processes():
    assert [s.limit for s in L.scopes(300, 60, 4)] == [75, 15, 75, 300]
    assert [s.limit for s in L.scopes(1, 1, 9)] == [1, 1, 1, 4]


def test_no_requests(spark):
    assert L.decisions(spark.createDataFrame([], HITS), L.scopes(2, 1)).count() == 0


@pytest.mark.parametrize(("most", "slices"), [(5, 3), (5, 4096), (150, 7), (1000, 7)])
def test_the_colder_half_is_dropped(spark, most, slices):
    rng = random.Random(most)
    rows = [(f"k{k}", rng.choice([None, 0, 39, 40, 41, *range(90, 100), 100])) for k in range(200)]
    live = sorted((last, key) for key, last in rows if last is not None and last >= 40)
    want = live if len(live) <= most else live[len(live) // 2 :]
    got = L.pruned(spark.createDataFrame(rows, "key string, last long"), 100, 60, most, slices).collect()
    assert sorted((r["last"], r.key) for r in got) == want
