"""Pages and rendered transcripts: structure, what is never read, odd and hostile markup."""

import hashlib
import time

import pytest

from quillspark.operators import bodies as B
from quillspark.operators.transcripts import read_transcripts, submissions


def turn(k, inside, role="user", more=""):
    return f'<section data-testid="conversation-turn-{k}" {more}><div data-message-author-role="{role}">{inside}</div></section>'


@pytest.fixture(scope="module")
def reading(spark):
    def read(markup, url="https://chat.e.org/c/0123456789abcdef"):
        return read_transcripts(spark.createDataFrame([("k", url, markup)], "key string, url string, html string")).first()

    read("")  # workers have started
    return read


def test_blocks_of_a_page():
    page = B.tree("<head><title>T</title></head><body>loose <b>bold</b><div><section><h2>Two</h2></section>tail</div><script>no()</script><div>one <i>block</i></div><p>never<p>closed<br>here<table><tr><td>1<td>2<tr><td>3</table></body>")
    parts = B.parts_of_page(page)
    assert [(p["kind"], p["text"]) for p in parts] == [("text", "loose bold"), ("heading", "Two"), ("text", "tail"), ("text", "one block"), ("text", "never"), ("text", "closedhere"), ("table", "123")]
    assert parts[-1]["structured"] == {"headers": ["1", "2"], "rows": [["3"]]} and B.text_of(parts[-1:]) == "1 | 2\n--- | ---\n3"


def test_lists_without_ends_and_repeated_attributes():
    [part] = B.parts_of('<ul><li>a<ul><li>b<li>c</ul><li>d</ul>')
    assert [(x["depth"], x["text"]) for x in part["structured"]["items"]] == [(0, "a"), (1, "b"), (1, "c"), (0, "d")]
    assert next(B.tree('<a href="x" href="y">').all("a")).attrs["href"] == "x"


@pytest.mark.parametrize("hostile", ["<p><div><b>" * 40_000, "<div><h1>x" * 40_000, "<ul><li><ul>" * 40_000, "<form><input>" * 40_000, '<i data-message-id="x">' * 40_000, "<table><tr><td><p>" * 30_000, "</p></b>" * 60_000, "<nav>" * 40_000 + '<b data-testid="workspace-switcher">' * 10_000])
def test_hostile_pages_take_time_in_proportion(reading, hostile):
    began = time.perf_counter()
    B.parts_of_page(B.tree(hostile))
    assert reading(hostile).messages == []
    assert time.perf_counter() - began < 30


def test_drafts_are_never_read(reading):
    said = turn(1, "said")
    row = reading(f"<form><main>{said}</main><input></form>" + "<form><input>" + "<p data-x>draft</p></form>" + f'<div contenteditable="true">{turn(2, "draft")}</div><div data-testid="prompt-textarea">{turn(3, "draft")}</div>')
    assert [m.text for m in row.messages] == ["said"]
    only = reading('<form><textarea>draft</textarea><div data-x="1">draft</div></form>')
    assert only.messages == [] and only.workspace.signals == []


def test_places_by_rules_in_order(reading):
    row = reading('<header><h1>Last</h1></header><b data-testid="conversation-title"> The  title </b>' + turn(0, "x", "critic") + turn(1, "", "user") + turn(2, "<p>yes</p>", "tool", 'data-is-streaming="true" data-message-model-slug="m"') + turn(3, '<time datetime="soon"></time><div class="prose">body</div>', "assistant"))
    assert (row.title, row.model, row.conversation) == ("The title", "m", "0123456789abcdef")
    assert [(m.position, m.role, m.text, m.streaming) for m in row.messages] == [(2, "tool", "yes", True), (3, "assistant", "body", False)]
    by_id = reading('<div data-message-id="a" data-message-author-role="user">one<div data-message-id="b" data-message-author-role="user">two</div></div>')
    assert [(m.message_id, m.text) for m in by_id.messages] == [("a", "two")]


def test_submissions_number_on_and_hash(spark):
    rows = [("k", "https://chat.e.org/c/0123456789abcdef", turn(4, "A  b") + turn(7, "c", more='data-is-streaming="true"')), ("none", None, None), ("empty", "", "")]
    out = submissions(read_transcripts(spark.createDataFrame(rows, "key string, url string, html string")), 10).orderBy("sequence_index").collect()
    assert [(r.sequence_index, r.position, r.completion_status, r.text, r.source_created_at) for r in out] == [(10, 0, "complete", "A b", None), (11, 1, "partial", "c", None)]
    assert out[0].content_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_pages_without_rows_or_markup(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], "page_id long, url string, html string, key string, text string")
    assert B.read_pages(empty).count() == 0 and submissions(read_transcripts(empty)).count() == 0
    [row] = B.read_pages(spark.range(1).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("html"), F.lit("odd").alias("title"))).collect()
    assert (row.title, row.parts, row.text, row.links) == ("", [], "", [])


def test_workspaces_take_all_cores_and_no_messages(spark, sf_dir, monkeypatch):
    from quillspark.operators import transcripts
    from quillspark.plans import catalogue

    def none(*given):
        raise AssertionError("messages are read")

    monkeypatch.setattr(transcripts, "read_transcripts", none)
    monkeypatch.setitem(catalogue.QUERIES["workspace_observations"].__globals__, "read_transcripts", none)
    got = catalogue.QUERIES["workspace_observations"](spark, sf_dir)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and got.count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
