"""Markup that is stored keeps rich text and nothing active."""

import pytest

from quillspark.operators.allowed_markup import safe_address, sanitised
from quillspark.operators.bodies import parts_of, text_of


@pytest.mark.parametrize(
    "sent",
    [
        "<p>before<script type=module src=//cdn.invalid/a.js></script>after", "<video poster=p onerror=\"steal()\"><source src=v></video>", "<b onmouseover = 'go()'>hover</b>", "<iframe srcdoc='&lt;p&gt;'>", "<a href=\"javascript://%0astart()\">go</a>",
        "<embed src=flash.swf><object><param name=movie></object>", "<svg><animate onbegin=run() attributeName=x></svg>", "<a href='\tJaVaScRiPt&colon;run()'>tab</a>", "<a href='&#106;&#97;vascript:run()'>coded</a>",
        "<scr<script></script>ipt>run()</scr<script></script>ipt>", "<p>&lt;script src=x&gt; and javascript:run()</p>", "<textarea></p><img src=q onerror=run()></textarea>", "<title><div onclick=run()></title>", "<math><mtext><script>run()</script></mtext></math>",
    ],
)
def test_nothing_active_is_left(sent):
    left = (sanitised(sent) or "").lower()
    assert not any(x in left for x in ("<script", "onerror", "onmouseover", "onclick", "onbegin", "javascript:", "<iframe", "<object", "<svg", "<embed", "<video", "<math"))


def test_rich_text_stays():
    rich = '<h3 class="day">Tides</h3><ol start="3" type="a"><li>High at <time datetime="06:10">ten past six</time></li><li><del>Low</del> <ins>Slack</ins></li></ol><blockquote>so <cite>they</cite> say</blockquote><table><caption>Harbour</caption><tbody><tr><td colspan="2"><kbd>Esc</kbd></td></tr></tbody></table><figure><img src="/pier.png" alt="pier" width="4"><figcaption>x<sup>2</sup></figcaption></figure><a href="mailto:quay@tides.invalid" title="Quay">write</a>'
    assert sanitised(rich) == rich


def test_nothing_unclosed_text_and_length():
    assert sanitised(None) is None and sanitised("") is None and sanitised("<script></script><!-- x -->") is None
    assert sanitised("<b>a<i>b</b>c</i>") == "<b>a<i>b</i></b>c"
    assert sanitised("a < b & c &nbsp;d") == "a &lt; b &amp; c  d"
    assert len(sanitised("x" * 2_000_001)) == 2_000_000
    assert sanitised("<p>" * 3000).count("</p>") == 3000


def test_addresses():
    assert [safe_address(x) for x in ("https://e.org/a:b", "mailto:a@e.org", "/x", "#y", "x.png", "?q=a:b", "")] == [True] * 7
    assert [safe_address(x) for x in ("javascript:x", "data:text/html,x", "java\nscript:x", "ftp://e.org", "vb`script:x", "1x:y", "http://[")] == [False] * 7


def test_deep_and_unbalanced_markup_of_a_million_characters():
    deep = "<ul><li>" * 60_000 + "x" + "</b>" * 100_000
    assert sanitised(deep).endswith("x" + "</li></ul>" * 60_000)
    [part] = parts_of(deep)
    assert part["text"] == "x" and part["structured"]["items"][-1] == {"depth": 59_999, "text": "x"}
    assert text_of(parts_of("<div>" * 50_000 + "y")) == "y"
