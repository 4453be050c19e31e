"""Operator 1's texts as classes, and its training step."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import lm
from quillspark.llm.common import table

TEXTS = ["", " a  B\t\x0bc\x0cC\r\n", "\x1c\x1d\x85  x y ", "A\xc4\xc9 İ\xa0x y", "  ", "ab\0c ab\0c", "z" * 300 + " Z"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_equal_the_pattern(kind):
    words, lengths = lm.words_of(pa.array(["cut off", *TEXTS], kind).slice(1))
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in TEXTS]
    assert lengths.tolist() == [len(w) for w in want]
    assert words.to_pylist() == [x.encode() for w in want for x in w]


def test_slices_hold_all_rows_and_few_bytes():
    b = pa.RecordBatch.from_pydict({"text": ["abc", "", "defgh", "ij", "x" * 50, "", "kl"]})
    parts = [x.column("text").to_pylist() for x in lm._slices(iter([b.slice(0, 0), b]), "text", 10)]
    assert parts == [["abc", "", "defgh", "ij"], ["x" * 50], ["", "kl"]] and [t for p in parts for t in p] == b.column("text").to_pylist()


@pytest.mark.parametrize("size", [1, 5, 4 * lm.BATCH])
def test_steps_are_the_texts_in_order(size):
    rng = np.random.default_rng(size)
    texts = [np.r_[rng.integers(1, 9, rng.integers(0, size)), 0].astype(np.uint8) for _ in range(60)]
    want = np.concatenate([np.stack([np.r_[0, t[:-1]], np.r_[0, 0, t[:-1]][: len(t)], t]) for t in texts], axis=1)
    steps = list(lm._steps(iter(texts)))
    assert np.array_equal(np.concatenate([np.stack(s) for s in steps], axis=1), want)
    assert all(len(s[0]) == lm.BATCH for s in steps[:-1])


def test_a_step_equals_a_plain_one():
    rng, k, width = np.random.default_rng(4), 20, 6
    mass = rng.random(k) + 0.1
    model, log_noise = lm.Model.start(mass, width), np.log(mass / mass.sum()).astype(np.float32)
    v, u, w, noise = rng.integers(0, k - 3, 90), rng.integers(0, k, 90), rng.integers(0, k, 90), rng.integers(0, k, 7)
    for _ in range(3):
        tables, adapted = model.tables.astype(float), model.adapted.astype(float)
        grad = np.zeros_like(tables)
        for a, b, c in zip(v, u, w, strict=True):
            hidden = tables[a, :-1] + tables[k + b, :-1]
            for x, true in ((c, 1), *((x, 0) for x in noise)):
                score = hidden @ tables[2 * k + x, :-1] + tables[2 * k + x, -1] - log_noise[x] - math.log(len(noise))
                g = (true - 1 / (1 + math.exp(-score))) / len(w)
                for at in (a, k + b):
                    grad[at, :-1] += g * tables[2 * k + x, :-1]
                grad[2 * k + x] += g * np.r_[hidden, 1]
        adapted += grad**2
        tables += lm.RATE * grad / np.sqrt(adapted)
        model.train(v, u, w, noise, log_noise)
        assert np.allclose(model.tables, tables, atol=1e-5) and np.allclose(model.adapted, adapted, atol=1e-6)


def test_texts_are_read_for_counts_and_classes_alone(spark, sf_dir, monkeypatch):
    """Not once more for each round, whose shuffles hold classes."""
    docs, dealt, trained = table(spark, sf_dir, "documents").select("doc_id", "text"), [], lm.trained
    rows, read = docs.count(), spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    monkeypatch.setattr(lm, "trained", lambda given, *more: dealt.append(given.columns) or trained(given, *more))
    assert len(lm.lm_scores(docs.mapInArrow(counting, docs.schema), endings=16, width=8).collect()) == rows
    assert read.value <= 3 * rows  # words, number of texts, classes
    assert len(dealt) == len(lm.ROUNDS) and all("text" not in c for c in dealt)
