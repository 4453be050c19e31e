"""Operators 3 and 10 against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import components, simhash, suffix_dedup
from quillspark.llm.common import joined_runs, stored, table
from quillspark.llm.sampled_positions import Names, marks, nodes

from .helpers import empty, odd, odd_rows


def fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints: list[tuple]) -> dict[int, object]:
    """fingerprint -> smallest id reachable, over all pairs."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    smallest = {}
    for d, f in prints:
        k = find(f)
        if d is not None and (smallest.get(k) is None or d < smallest[k]):
            smallest[k] = d
    return {f: smallest.get(find(f)) for f in distinct}


def check_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, fingerprint(r.text)) for r in rows]
    own = classes(prints)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == Counter((d, f"{f:016x}", own[f]) for d, f in prints)


def test_near_duplicates_equal_all_pairs(spark, sf_dir):
    check_simhash(table(spark, sf_dir, "documents"))
    check_simhash(odd(spark))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_large_signatures_lose_no_link(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(120)} | {r.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = classes([(i, f) for i, f in enumerate(sorted(fps))])
    groups = Counter(want.values())
    for block in (4096, 16):
        pairs = simhash.near_pairs(df, block=block)
        found = {r.node: r.root for r in components.components(pairs).collect()}
        assert sorted(Counter(found.values()).values()) == sorted(n for n in groups.values() if n > 1)
        for x in pairs.collect():
            assert ((x.a ^ x.b) & (1 << 64) - 1).bit_count() <= 4


@pytest.mark.parametrize("distance", [0, 1, 4, 5])
def test_finer_signatures_keep_every_link(spark, distance):
    """One segment is the same everywhere, so that its signatures are large and are split by the other bits."""
    r = random.Random(9)
    base = [0x2A5A5 | r.getrandbits(42) << 22 for _ in range(150)]
    fps = sorted({b ^ sum(1 << x for x in r.sample(range(64), n)) for b in base for n in range(distance + 2)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    near = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= distance}
    found = simhash.near_pairs(df, distance, block=16, split=2)
    got = {tuple(sorted((x.a % (1 << 64), x.b % (1 << 64)))) for x in found.collect()}
    assert got <= near and _classes(got) == _classes(near)
    assert simhash.large_signatures(df.distinct(), 16).agg({"blocks": "max"}).first()[0] > 2


def _classes(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = {}
    for x in list(root):
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 50)] + [(500, 499), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in components.components(df).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 50)}, 499: 499, 500: 499}
    assert components.components(df.limit(0)).count() == 0


def test_one_of_each_keeps_one_row_a_component(spark):
    kept = simhash.first_of_each(odd(spark), stored(simhash.fingerprints(odd(spark)))).collect()
    assert set(kept[0].asDict()) == set(odd(spark).columns)
    prints = [(r[0], fingerprint(r[1])) for r in odd_rows()]
    assert len(kept) == len({f for _, f in prints})  # no two different texts here are near
    assert Counter(fingerprint(r.text) for r in kept).most_common(1)[0][1] == 1
    assert {r.doc_id for r in kept} == {classes(prints)[f] for _, f in prints}


def removed(texts: list, size: int) -> list[tuple]:
    seen: Counter = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def planted():
    r = random.Random(3)
    rnd = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [rnd(n) for n in (399, 400, 401, 450, 700, 1500)]
    texts = ["", None, "a" * 3000, "ab" * 900, "a" * 399, rnd(900) + "a" * 600]
    for _ in range(60):
        t = rnd(r.randint(0, 600))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            t += p[r.randint(0, r.randint(0, 300)) : len(p) - r.randint(0, 200)] + rnd(r.randint(0, 30))
        texts.append(t)
    base = rnd(3000)
    for _ in range(12):
        x = list(base)
        for _ in range(r.randint(1, 12)):
            x[r.randint(0, 2999)] = "#"
        texts.append("".join(x))
    return [*texts, base, base]


@pytest.mark.parametrize("size, widths, most, places", [(400, suffix_dedup.WIDTHS, 1 << 23, 1 << 29), (400, suffix_dedup.WIDTHS, 0, 1 << 29), (400, (130, 12, 1), 0, 1), (60, (16, 4, 1), 1 << 23, 1)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, size, widths, most, places):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", most)
    monkeypatch.setattr(suffix_dedup, "PLACES", places)
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, suffix_dedup.suffix_dedup(df, size, widths).collect()))
    assert [r[1:] for r in got] == removed(texts, size)


def test_suffix_dedup_odd_rows(spark):
    got = Counter(tuple(r)[1:] for r in suffix_dedup.suffix_dedup(odd(spark)).collect())
    assert got == Counter(removed([r[1] for r in odd_rows()], 400))
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=40, max_size=300), st.integers(1, 12))
def test_windows_with_equal_bytes_get_equal_marks_and_names(data, width):
    size, data = 32, data + data
    names = Names(data)
    n = len(data) - size + 1
    mark = marks(names, n, size)
    for s in range(n):
        t = data.find(data[s : s + size])
        assert mark[s] - s == mark[t] - t
    u, v, anchor = nodes(mark, 0, n - 1, width)
    assert u[0] == 0 and v[-1] == n - 1 and (u[1:] == v[:-1] + 1).all()
    assert ((anchor - width + 1 <= u) & (v <= anchor)).all()


def test_long_texts_are_taken_in_segments(spark, monkeypatch):
    import quillspark.llm.suffix_dedup as module

    monkeypatch.setattr(module, "SEGMENT", 500)
    r = random.Random(9)
    a = "".join(r.choice("abcdef") for _ in range(2500))
    texts = [a, "".join(r.choice("abcdef") for _ in range(1700)) + a[600:1900], "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(x)[1:] for x in sorted(suffix_dedup.suffix_dedup(df).collect())] == removed(texts, 400)


def test_runs_of_spans_are_joined(spark):
    r = random.Random(4)
    rows = [[], [(0, 5)], [(0, 5), (5, 6), (7, 9)]] + [sorted((a, a + r.randrange(1, 9)) for a in r.choices(range(60), k=r.randrange(1, 30))) for _ in range(40)]

    def joined(spans):
        runs = []
        for a, z in spans:
            if runs and a <= runs[-1][1]:
                runs[-1] = runs[-1][0], max(runs[-1][1], z)
            else:
                runs.append((a, z))
        return runs

    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, s array<struct<u:int,end:int>>")
    assert [[tuple(x) for x in r.x] for r in df.select("i", F.expr(joined_runs("s", "u")).alias("x")).orderBy("i").collect()] == [joined(x) for x in rows]
