"""Operators 12 and 13 against plain recomputation."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quillspark.llm import registry, resampling, vector_codes
from quillspark.llm.common import table

from .helpers import empty, odd, odd_rows

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, v string, sums string, kept string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, label, "c", 1, "v", "s", "k") for i, x, label in rows], VECTORS).repartition(3)


def plain_codes(rows, rounds=6, entries=16, parts=8):
    """Every part against every entry, in Python's integers."""
    kept = [(i, [math.floor(4096 * x) for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    cut = lambda v, p: v[length * p // parts : length * (p + 1) // parts]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[nearest(cut(v, p), books[p])].append(cut(v, p))
            books[p] = [[sum(xs) // len(own[k]) for xs in zip(*own[k], strict=True)] if k in own else c for k, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by_label = [], Counter()
    for i, v, label in kept:
        code = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][k]) for p, k in enumerate(code))
        by_label[label] += error
        out.append((i, bytes(code).hex(), error, label))
    return Counter((i, c, e, by_label[label], digest) for i, c, e, label in out)


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 19))
    rows = [(k, [float(np.float32(x)) for x in np.round((centres[k % 5] + rng.normal(size=19) * 0.05) * 4) / 4], k % 3 if k % 4 else None) for k in range(150)]  # coarse: many ties
    rows += [rows[3], rows[3], (None, rows[8][1], 1), (200, None, 1), (201, [float("nan")] * 19, 1), (202, [None] * 19, 2), (203, [float("inf")] * 19, 2)]
    assert Counter(map(tuple, vector_codes.vector_codes(vectors(spark, rows)).collect())) == plain_codes(rows)


def test_few_vectors_odd_lengths_and_empty_tables(spark):
    rows = [(5, [0.5] * 3, 1), (9, [0.25] * 3, None), (11, [0.5] * 4, 1), (12, [], None), (13, [1e30] * 3, 7)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.vector_codes(vectors(spark, rows)).collect()}
    assert got == {5: ("0" * 16, 0, 0), 9: ("0000010000010001", 0, 0), 11: (None, None, 0), 12: (None, None, 0), 13: (None, None, None)}
    for none in ([], [(1, None, 1)]):
        assert vector_codes.vector_codes(vectors(spark, none)).count() == 0
    assert [tuple(r)[:4] for r in vector_codes.vector_codes(vectors(spark, [(1, [], 1)])).collect()] == [(1, None, None, None)]


def test_bounds_spare_scans_and_change_nothing(spark, sf_dir):
    kept = vector_codes.quantised(table(spark, "/root/testdata/sf0.1", "embeddings"))
    rows, books, length, scans = vector_codes.trained(kept)
    assert length == 64 and scans[0] <= 8 * rows.count() and scans[-1] < 0.7 * scans[0]
    x = np.array([r.v for r in kept.collect()], np.int64)
    by_id = {r.vec_id: r for r in rows.collect()}
    for p, book in enumerate(books):
        nearest = vector_codes.squares(x[:, 8 * p : 8 * p + 8], book.entries).argmin(1)
        assert [by_id[r.vec_id].code[p] for r in kept.collect()] == nearest.tolist()


def test_squares_are_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-(2**28), 2**28, (40, 3)), rng.integers(-(2**28), 2**28, (5, 3))
    assert vector_codes.squares(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in c] for r in x]


def plain_draw(docs, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def buckets(t):
        w = words(t)
        return [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    total = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total[0] + 10_000) / ((s[b] + 1) * (total[1] + 10_000))))
    out = []
    for i, x in docs:
        own = buckets(x)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    return out


def ranks(rows):
    """Ranks may go to any of the rows that are equal in score and doc_id: (doc_id, features, weight, score) without, and ranks by score and doc_id."""
    order = sorted((-r[3], r[0] is not None, r[0] or 0) for r in rows if r[4] >= 20)
    drawn = Counter((i if known else None, -s) for s, known, i in order[: len(order) * 25 // 100])
    return Counter(r[:4] for r in rows), drawn


@pytest.mark.parametrize("kind", ["given", "odd"])
def test_draw_equals_plain_recomputation(spark, sf_dir, kind):
    target = table(spark, sf_dir, "benchmark")
    docs = odd(spark) if kind == "odd" else table(spark, sf_dir, "documents")
    got = resampling.resampled(docs, target).collect()
    rows = [r[:2] for r in odd_rows()] if kind == "odd" else [(r.doc_id, r.text) for r in docs.collect()]
    want, drawn = ranks(plain_draw(rows, [r.text for r in target.collect()]))
    assert Counter(tuple(r)[:4] for r in got) == want
    ranked = sorted((r.rank, -r.score, r.doc_id is not None, r.doc_id or 0) for r in got if r.rank)
    assert [r[0] for r in ranked] == list(range(1, sum(drawn.values()) + 1)) and [r[1:] for r in ranked] == sorted(r[1:] for r in ranked)
    assert Counter((r.doc_id, r.score) for r in got if r.rank) == drawn


def test_words_across_slices_and_long_words(monkeypatch):
    texts = ["", "Ab" * 5000, "a b", "", "\x00", "z" * 64 + " " + "é" * 200, "one,two;THREE", ""]
    data = [t.encode() for t in texts]
    bucket, text, n = resampling.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = Counter()
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        want.update((k, zlib.crc32(x.encode()) % 10_000) for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])
    assert Counter(zip(text.tolist(), bucket.tolist(), strict=True)) == want and n.tolist() == [0, 1, 2, 0, 0, 2, 3, 0]


def test_no_documents_and_no_target(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert resampling.resampled(empty(spark), docs).count() == 0
    got = resampling.resampled(docs, empty(spark)).collect()
    assert len(got) == docs.count() and any(r.rank == 1 for r in got)


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_resampling"])
def test_queries_match_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf_dir)
    assert Counter(map(tuple, got.collect())) == Counter(c.sql(f"select {', '.join(got.columns)} from ({registry.ORACLE[name]})").fetchall())
