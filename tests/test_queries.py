"""Every query with SQL gives what DuckDB gives on the same tables; the others are checked on their own below."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import capture as C
from quillspark.operators import identity as I
from quillspark.operators.markup import Page, parts_to_text
from quillspark.plans import catalogue, operations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def canonical(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    ours = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    theirs = duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_three_layer_identity_has_the_known_counts(spark, sf_dir):
    r = catalogue.QUERIES["identity_three_layer"](spark, sf_dir).toPandas()
    assert (len(r), r.versions.sum(), (r.versions > 1).sum(), (r.status == "partial").sum(), r.identical.sum(), r.reconciled.sum()) == (89, 100, 11, 2, 36, 4)


def test_current_version_does_not_move_back_on_a_b_a(spark):
    rows = [(1, 0, "user", text, 0, None, "complete", f"capture:{k}", k) for k, text in enumerate(["A", "B", "A"])]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long, source_id string, status string, key string, arrival long")
    [row] = I.current(I.versions(log)).collect()
    assert row.version_count == 2
    assert row.current_digest == spark.range(1).select(T.content_hash(F.lit("B"))).first()[0]


def test_normalise(spark):
    df = spark.createDataFrame([("  Hello   WORLD \n",), ("ＨＥＬＬＯ",), ("Straße",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.normalise("t")).collect()] == ["hello world", "hello", "strasse", None, ""]


def test_safe_filenames(spark):
    cases = {"../../etc/passwd": "passwd", "..\\..\\windows\\system32\\cmd.exe": "cmd.exe", "report final.pdf": "report_final.pdf", "": "attachment.bin", "photo (1).png": "photo__1.png", "...": "file", "$(rm -rf /).png": "file.png"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.f for r in df.select("n", T.safe_filename(F.col("n")).alias("f")).collect()} == cases


def test_time_buckets(spark):
    df = spark.createDataFrame([(1000,), (1120,), (2800,), (None,)], "s long")
    a, b, c, d = (r[0] for r in df.select(T.bucket(F.col("s"))).collect())
    assert a == b != c and d == 0


def test_splits_are_disjoint_and_near_their_shares(spark):
    rows = spark.range(3000).select(T.split_name(F.col("id").cast("string"), {"train": 0.8, "validation": 0.1, "test": 0.1}).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 3000 for r in rows}
    assert set(share) == {"train", "validation", "test"} and 0.7 < share["train"] < 0.9


def test_rate_limit_ignores_denied_hits():
    hits = pd.DataFrame({"event_id": [1, 2, 3, 4], "user_id": 7, "at": [0, 10, 20, 100]})
    assert operations._limit(hits, window=60, most=2)["allowed"].tolist() == [True, True, False, True]


HOSTILE = """<html><head><title>T</title></head><body><h2>Head</h2><p onclick="x()">One <b>two</b></p><script>evil()</script>
<ul><li>a<ul><li>b</li></ul></li></ul><pre><code class="language-python">x = 1
y</code></pre><table><tr><th>h</th><td>c</td></tr></table><a href="javascript:alert(1)">bad</a><a href="https://e.org/x" onmouseover="y">ok</a><iframe src="z">no</iframe></body></html>"""


def test_markup_parts_and_safety():
    page = Page(HOSTILE)
    assert [(p["kind"], p["text"]) for p in page.parts[:5]] == [("heading", "Head"), ("paragraph", "One two"), ("list", "a"), ("list", "b"), ("code", "x = 1\ny")]
    assert page.parts[4]["language"] == "python" and page.title == "T"
    safe = "".join(page.safe)
    assert not any(x in safe for x in ("script", "onclick", "javascript", "iframe", "onmouseover", "evil"))
    assert page.links == [("https://e.org/x", "")]
    assert "```python\nx = 1\ny\n```" in parts_to_text(page.parts) and "  - b" in parts_to_text(page.parts)
    assert Page("").parts == []


def test_rejected_replayed_and_admitted_add_up(spark, sf_dir):
    log = C.capture_log(spark, sf_dir)
    n = {r.outcome: r["count"] for r in C.outcomes(log).groupBy("outcome").count().collect()}
    assert n == {"admitted": 140, "replayed": 23, "rejected": 2}


def test_filters_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["scan_filter_project"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1]
    assert "In(o_orderstatus" in pushed and "GreaterThanOrEqual(o_totalprice" in pushed


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_filenames_are_decomposed_and_bounded(spark):
    cases = {"Ünïcode résumé.PDF": "U_ni_code_re_sume.pdf", "ﬁle①.txt": "file1.txt", "a\u0000b​.md": "ab.md", "x" * 300 + ".jpeg": "x" * 123 + ".jpeg", "y" * 300: "y" * 128, "a.b..c": "a.b..c", "n.tar.gz": "n.tar.gz"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    got = {r.n: r.f for r in df.select("n", T.safe_filename(F.col("n")).alias("f")).collect()}
    assert got == {**cases, "a.b..c": "a.b.c"}
