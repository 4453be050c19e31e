"""Dropped elements without an end tag take nothing else with them."""

import pytest

from quillspark.operators.markup import Page


@pytest.mark.parametrize("dropped", ['<embed src="x">', '<embed src="x"/>', "<object><param name=a>hidden</object>", "<form>hidden<p>hidden</form>", "<svg><style>hidden</style><g>hidden</g></svg>", "<p>open<form>hidden</p>hidden</form>"])
def test_what_follows_a_dropped_element_stays(dropped):
    page = Page(f'<title>T</title><body><h1>one</h1>{dropped}<p>two <a href="https://e.org/x">three</a></p></body>')
    assert page.parts[-1]["text"] == "two three" and page.links == [("https://e.org/x", "")]
    safe = "".join(page.safe)
    assert safe.startswith("<h1>one</h1>") and safe.endswith('<p>two <a href="https://e.org/x">three</a></p>') and "hidden" not in safe


@pytest.mark.parametrize("tag", ["object", "noscript", "template", "svg", "form"])
def test_an_unclosed_element_ends_with_the_one_around_it(tag):
    page = Page(f"<div><p>one</p><div><{tag}>hidden <b>hidden</b></div><p>two</p></div><ul><li>three</ul>")
    assert [p["text"] for p in page.parts] == ["one", "two", "three"]
    assert "".join(page.safe) == "<div><p>one</p><div></div><p>two</p></div><ul><li>three</ul>"
