"""The pipeline's near-duplicate stage against all pairs of 5-word shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import simhash, similar

from .helpers import empty, odd


def jaccard(a: str, b: str) -> float:
    x, y = (frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def edited(r: random.Random, text: str, times: int) -> str:
    words = text.split()
    for i in r.sample(range(len(words)), times):
        words[i] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def texts_with_copies() -> list[str]:
    """Texts of 300 words and copies with 1 to 16 changed words (similarity 0.97 to 0.6), and a chain of edits."""
    r = random.Random(4)
    out = []
    for times in range(1, 17):
        for _ in range(4):
            base = " ".join(f"w{r.randrange(5000)}" for _ in range(300))
            out += [base, edited(r, base, times)]
    out.append(" ".join(f"w{r.randrange(5000)}" for _ in range(300)))
    for _ in range(4):
        out.append(edited(r, out[-1], 5))
    return out


def survivors(texts: list[str]) -> set[int]:
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in range(len(texts))}


def test_stage_keeps_one_of_each_component_of_similar_texts(spark, sf_dir):
    texts = texts_with_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = survivors(texts)
    assert 64 < len(want) < len(texts) - 20
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, sf_dir).collect()} == want
    assert {r.doc_id for r in similar.one_of_similar(df, block=3).collect()} == want


def test_large_components_lose_no_link(spark):
    r = random.Random(6)
    base = " ".join(f"w{r.randrange(5000)}" for _ in range(200))
    texts = [edited(r, base, r.randint(0, 6)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (similar.BLOCK, 16):
        assert {x.doc_id for x in similar.one_of_similar(df, block=block).collect()} == survivors(texts)


def test_bands_reach_the_threshold():
    r = np.random.default_rng(1)
    found = 0
    for _ in range(1000):
        every = r.integers(0, 1 << 63, 360, np.uint64)
        found += bool((similar.bands(every[:324]) == similar.bands(every[36:])).any())  # 288 of 360: similarity 0.8
    assert found >= 997


def test_odd_rows_and_uncovered_distances(spark):
    kept = similar.one_of_similar(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 7, 8, 9, 11]
    assert similar.one_of_similar(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(odd(spark), distance=6)


def test_fingerprints_alone_find_near_copies(spark, monkeypatch):
    """Without the bands, what is at most four bits apart is found, and checked."""
    texts = texts_with_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    prints = [simhash.fingerprint(simhash.shingle_hashes(t, similar.SHINGLE)) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= simhash.DISTANCE}
    assert len(near) > 3 and all(jaccard(texts[i], texts[j]) >= 0.8 for i, j in near)
    monkeypatch.setattr(similar, "banded_alike", lambda marked: spark.createDataFrame([], "a long, b long"))
    assert len({k for pair in near for k in pair}) == 2 * len(near)  # pairs, no chains
    assert {r.doc_id for r in similar.one_of_similar(df).collect()} == set(range(len(texts))) - {j for _, j in near}
