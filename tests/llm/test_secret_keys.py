"""Planted keys and names whose entropy spans are written down here, not taken from the allow list."""

import pytest

from quillspark.llm import secret_scan

LETTERS = "qWpZxKvTbNmLrYsDfGhJkQwErTyUiOpA"
MIXED = "aB3dE5gH7jK9mN1pQ2rS4tU6vW8x"
KEYS = [LETTERS, "qWpZxKv_TbNmLrYs-DfGhJkQw/ErTyUiOpA", f"examples/{LETTERS}", f"{LETTERS}/examples", f"docs/sample/{MIXED}/dummy-1", f"example-{MIXED}-123456", f"{MIXED}example{MIXED}"]
HEX = ["abcdef/9f8e7d6c5b4a39281706f5e4", "012345A9F8E7D6C5B4A392817"]
NAMES = [
    "kebab-case-words-in-a-long-row", "/usr/local/share/doc/readme/first-things", "getElementsByClassNameOfDocument", "Project_Quarterly_Report_2024-final", "com/example/project/ServiceFactoryProvider", "thequickbrownfoxjumpsoverthelazydog",
    "THEQUICKBROWNFOXJUMPSOVERTHELAZYDOG", "placeholder-aB3dE5gH7jK9m", "0123456789abcdef0123456789",
]


def entropy_spans(spark, texts: list[str]) -> list[list[str]]:
    rows = secret_scan.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [[x for x in r.spans.split(",") if x.startswith("entropy")] for r in sorted(rows)]


@pytest.mark.parametrize("before", ["", "the key is "])
def test_planted_keys_have_spans(spark, before):
    got = entropy_spans(spark, [f"{before}{k} ." for k in KEYS])
    assert got == [[f"entropy64:{len(before)}:{len(before) + len(k)}"] for k in KEYS]
    assert entropy_spans(spark, [f"{before}{HEX[0]} ."])[0][-1] == f"entropy16:{len(before) + 7}:{len(before) + 31}"
    assert entropy_spans(spark, [f"{before}{HEX[1]} ."])[0][-1] == f"entropy16:{len(before)}:{len(before) + 25}"


def test_names_and_samples_have_none(spark):
    assert entropy_spans(spark, NAMES) == [[] for _ in NAMES]


def test_planted_keys_are_masked(spark):
    df = spark.createDataFrame([(i, f"a {k} b") for i, k in enumerate(KEYS)], "doc_id long, text string")
    assert {r.text for r in secret_scan.redacted(df).collect()} == {"a [SECRET] b"}


def test_candidates_of_a_million_characters(spark):
    joined = ["ab-cd/ef_" * 110_000, "1234-5678/" * 100_000, "CamelCaseWord/" * 72_000, "example" * 150_000, "-" * 1_000_000, "12" * 500_000]
    key = "ab-cd/ef_" * 110_000 + LETTERS
    assert entropy_spans(spark, [f"see {x} end" for x in [*joined, key]]) == [[]] * len(joined) + [[f"entropy64:4:{4 + len(key)}"]]
    df = spark.createDataFrame([(i, f"see {x} end") for i, x in enumerate([*joined[:-1], key])], "doc_id long, text string")
    assert [r.text for r in sorted(secret_scan.redacted(df).collect())] == [*(f"see {x} end" for x in joined[:-1]), "see [SECRET] end"]
