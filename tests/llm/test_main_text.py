"""Operator 11: written-out pages, held-out labelled pages, and time on hostile ones."""

import html
import re
import time

import pytest

from quillspark.llm import main_text as M
from quillspark.llm import registry
from quillspark.llm.common import table

PROSE = "Every morning the ferry left the island a little after six, and nobody on the quay ever looked at the clock to know it. " * 3
MENU = '<ul class="menu"><li><a href="/">Home</a><li><a href="/n">News</a><li><a href="/c">Contact us</a></ul>'

PAGES = {
    f"<header><a href='/'>The Paper</a></header>{MENU}<main><h1>Ferry &amp; sea</h1><p>{PROSE}</p></main><aside><p>{PROSE}</p></aside><footer>&copy; 2024</footer>": f"Ferry & sea {PROSE}",
    f"<div id=cookie-notice>We use cookies on this page, and so do all our many partners.</div><article><p>{PROSE}<p>Short.<ul><li>one<li>two</ul></article>": f"{PROSE} Short. one two",
    f"<article><h1>T</h1>a<b>b</b>c<br>d&nbsp;&lt;e&gt; <script>if (a<b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> -->{PROSE}</article>": f"T abc d <e> {PROSE}",
    f"<article><p>{PROSE}</p><form><label>Mail</label><input value=x><button>Send now</button></form><div class='share-buttons'>Share this</div><p>End.</p></article><section id='comments'><article><p>{PROSE} I agree.</p></article></section>": f"{PROSE} End.",
    f"<body class='has-sidebar'>{MENU}<div><h2>Bare</h2><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p></div><div>All rights reserved</div>": f"Bare {PROSE} Yes. {PROSE}",
    f"<div class='wrapper'><div class='left-sidebar'>{PROSE}</div><div class='post-content'><p>{PROSE}<div class=ad>Buy</div><p>{PROSE}": f"{PROSE} {PROSE}",
    f"<p>{PROSE}</p><noscript>Turn scripts on</noscript><div hidden>{PROSE}</div><p style='display: none'>x</p><select><option>y</select>": PROSE,
    f"<title>x</title>{MENU}<a href=1>Ferry</a> <a href=2>Sea</a>": "",
    f"<article><a title='a > b' href=x>Link</a> in text. {PROSE}</article": f"Link in text. {PROSE}",
    f"<article><b>bold <p>{PROSE}</b> after</p><i>{PROSE}</article><footer>foot": f"bold {PROSE} after {PROSE}",
    f"<table><tr><td class=sidebar>{PROSE}<td><article>{PROSE}</article></table>": PROSE,
    f"{MENU}<article><h1>Sea</h1><p>{PROSE}</p><p>Six short words are the end.": f"Sea {PROSE} Six short words are the end.",
    "": "",
    " \n ": "",
    "1 < 2 & 3 > 2": "",
}


def test_written_out_pages():
    for page, want in PAGES.items():
        assert M.articles([page]) == [" ".join(want.split())], page


def test_pages_of_a_batch_are_independent():
    pages = list(PAGES)
    assert M.articles(pages + pages[::-1]) == [" ".join(x.split()) for x in (list(PAGES.values()) + list(PAGES.values())[::-1])]


def test_whole_table_equals_the_article_elements(spark, sf_dir):
    """The given pages mark their articles, so that plain patterns find them."""
    rows = table(spark, sf_dir, "pages").collect()
    want = {}
    for r in rows:
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>|</?p>|</?h1>", " ", inner))).split())
    got = registry.op11_main_text(spark, sf_dir).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_tree_holds_on_pages_it_has_not_seen():
    right = total = 0
    for k in range(len(M.LABELLED)):
        tree = M.Tree(*M.labelled_table(M.LABELLED[:k] + M.LABELLED[k + 1 :]))
        x, y = M.labelled_table(M.LABELLED[k : k + 1])
        right, total = right + (tree.predict(x) == y).sum(), total + len(y)
    assert right >= 0.88 * total
    assert (M.grown().predict(M.labelled_table()[0]) == M.labelled_table()[1]).all()


@pytest.mark.parametrize("piece", ["<b", "<p>", "<div>", '<a href="', "<i>", "&", "<!--", "<script>", "</p>", "<table><td>", "<p class='a b'>", "<a><div>", "< ", "<p =", "<ul><li>x"])
def test_time_is_linear(piece):
    took = []
    for n in (40_000, 160_000):
        began = time.perf_counter()
        M.articles([piece * n])
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1


def test_odd_and_empty_tables(spark):
    kind = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", f"<article>{PROSE}</article>", "x", 1), (1, "u", f"<article>{PROSE}</article>", "x", 1), (None, None, None, None, None), (2, None, "", "y", 2), (3, "v", "<article>" + PROSE * 2000, "z", 3)]
    got = sorted(map(tuple, M.main_text(spark.createDataFrame(rows, kind).repartition(3)).collect()), key=str)
    one = " ".join(PROSE.split())
    many = " ".join((PROSE * 2000).split())
    assert got == sorted([(1, "u", one, len(one))] * 2 + [(None, None, "", 0), (2, None, "", 0), (3, "v", many, len(many))], key=str)
    assert M.main_text(spark.createDataFrame([], kind)).count() == 0
