"""Operators 1 and 2 and the pipeline."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import lm, registry, topk
from quillspark.llm.common import stored, table

from .helpers import empty, odd, odd_rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_scores(rows):
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    tokens = [[*words(t), None] for _, t in rows]
    c = Counter(x for ts, h in zip(tokens, held, strict=True) if not h for x in ts)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ts), sum(c[x] > 0 for x in ts), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)) for (d, _), h, ts in zip(rows, held, tokens, strict=True)]


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


@pytest.mark.parametrize("head", [lm.HEAD, 1500, 0])
def test_base_scores_equal_brute_force(spark, sf_dir, head):
    docs = table(spark, sf_dir, "documents")
    got = lm.lm_scores(docs, head=head, endings=16, width=8).collect()
    same(got, base_scores([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_odd_and_empty_tables(spark):
    same(lm.lm_scores(odd(spark), endings=8, width=4).collect(), base_scores([r[:2] for r in odd_rows()]))
    assert lm.lm_scores(empty(spark)).count() == 0


def test_without_training_texts_scores_are_base_scores(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    [r] = lm.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    follow = rng.permutation(12)
    seen = [0, 0]
    for _ in range(60_000):
        seen.append(int(follow[seen[-1]]) if rng.random() < 0.8 else int(rng.integers(12)))
    seen = np.array(seen)
    mass = np.bincount(seen, minlength=12) + 1.0
    model, share = lm.Model.start(mass, 8), mass / mass.sum()
    log_noise = np.log(share).astype(np.float32)
    for i in range(2, len(seen) - 512, 512):
        noise = rng.choice(12, 32, p=share)
        model.train(seen[i - 1 : i + 511], seen[i - 2 : i + 510], seen[i : i + 512], noise, log_noise)
    one, two, bias, norm = model.log_tables()
    for v, u in ((0, 0), (3, 7), (11, 2)):
        assert math.isclose(np.exp(one[v].astype(float) + two[u] + bias - norm[v, u]).sum(), 1, rel_tol=1e-5)
    w, v, u = seen[2:], seen[1:-1], seen[:-2]
    assert (one[v, w] + two[u, w] + bias[w] - norm[v, u]).mean() > np.log(share)[w].mean() + 0.5


def test_held_out_texts_score_above_the_base(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [r for r in lm.lm_scores(docs).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in rows) > 0.2 * sum(r.n_tokens for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.85 * len(rows)


@pytest.mark.parametrize("head", [lm.HEAD, 300])
def test_scores_equal_a_slow_recomputation(spark, sf_dir, head):
    docs = lm.marked(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text")))
    fitted = lm.fit(docs.where("not held_out"), head=head, endings=32, width=8, shard=20_000)
    rows = [tuple(r) for r in docs.collect()]
    c = Counter(w for _, t, h in rows if not h for w in words(t))
    own = {w.decode(): i for i, w in enumerate(fitted.known.head[: fitted.known.own], 1)}
    k = len(own) + 1 + 32
    of = lambda w: own.get(w) or len(own) + 1 + zlib.crc32(w.encode()[-2:]) % 32
    mass = Counter({x: 0.5 for x in range(len(own) + 1, k)})
    for w, n in c.items():
        mass[of(w)] += n + 0.5
    one, two, target = (fitted.model.tables[i * k : (i + 1) * k, :-1].astype(float) for i in range(3))
    bias = fitted.model.tables[2 * k :, -1].astype(float)

    def probabilities(v, u):
        x = np.exp((one[v] + two[u]) @ target.T + bias)
        return x / x.sum()

    total = probabilities(of("der"), of("never seen"))
    assert math.isclose(total[0] + sum(total[of(w)] * (n + 0.5) / mass[of(w)] for w, n in c.items()) + sum(total[x] * 0.5 / mass[x] for x in range(len(own) + 1, k)), 1, rel_tol=1e-9)
    want = []
    for d, t, h in rows:
        score, seen = 0.0, [0, 0]
        for w in [*words(t), None]:
            x = 0 if w is None else of(w)
            score += math.log10(probabilities(seen[-1], seen[-2])[x]) + (math.log10((c[w] + 0.5) / mass[x]) if w is not None and w not in own else 0)
            seen.append(x)
        want.append((d is not None, d or 0, h, len(seen) - 2, score))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.score) for r in lm.scores(docs, fitted).collect())
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]
    assert np.allclose([g[4] for g in got], [w[4] for w in sorted(want)], rtol=1e-6)


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    one, other = ([(r.doc_id, r.score / r.n_tokens) for r in sorted(lm.lm_scores(docs.repartition(n), shard=10_000).collect())] for n in (2, 16))
    assert [d for d, _ in one] == [d for d, _ in other]
    assert np.allclose([s for _, s in one], [s for _, s in other], atol=1e-4)


def test_top_k_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    vectors = table(spark, sf_dir, "embeddings").repartition(5)
    want = Counter(c.sql(topk.ORACLE).select("query_id", "rank", "vec_id", "score").fetchall())
    assert Counter(map(tuple, topk.top_k(vectors).collect())) == want
    assert Counter(map(tuple, topk.top_k(vectors, block=2).collect())) == want


def test_top_k_ties_nulls_lengths_and_large_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (100, [0.25, 0.0]), (200, [1e6, -1e6]), (None, [1.0, 1.0]), (5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 0.0]), (9, []), (10, [1.0, 2.0, 3.0]), (300, [0.5, 0.5, 0.5])]
    rows += [(1000 + i, [0.5, 0.5]) for i in range(1, 40)] + [(1001, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    want = Counter()
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, x in usable:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in usable if i != q and len(y) == len(x))
            want.update((q, k, i, -s) for k, (s, i) in enumerate(scores[:10], 1))
    assert Counter(map(tuple, topk.top_k(df).collect())) == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_scores_beyond_exact_floats_keep_every_entry(spark):
    rows = [(i, [float(2**20 + 3 * i), 1.0 + i / 7, 5.0, 0.25]) for i in range(200)] + [(500 + i, [float(2**20)] * 3 + [0.5]) for i in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = Counter()
    for q, x in whole:
        if q % 100 == 0:
            want.update((q, k, i, -s) for k, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole if i != q)[:10], 1))
    assert Counter(map(tuple, topk.top_k(df).collect())) == want


def test_a_large_query_is_exact():
    x, q = np.array([[2**40, 3]]), np.array([[2**20, -1]])
    assert topk._product(x, q)[0, 0] == 2**60 - 3


def test_pipeline_stages_do_what_they_say(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_dedup", "secret_scans", "best_fit_packing"]
    docs = table(spark, sf_dir, "documents")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        counts.append(docs.count())
        assert docs.select("doc_id").distinct().count() == counts[-1]
    total = table(spark, sf_dir, "documents").count()
    assert total > counts[0] > counts[1] == counts[2] == counts[3] > 0
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_every_operator_is_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE) <= set(registry.QUERIES)
