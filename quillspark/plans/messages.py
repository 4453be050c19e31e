"""Message bodies with their structure, and the full rules of what a client may submit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.allowed_markup import with_sanitised
from ..operators.bodies import read_bodies
from ..sources.tables import table
from .registry import query

_KEY = "concat(conv_id, '-', turn)"
#: A rendered body for each turn, in SQL that both engines read.
_HTML = """concat('<p>Turn ', turn, '  of <b>', conv_id, '</b></p><h2>', role, '</h2><ol><li>first ', turn, '</li><li>second<ul><li>inner ', conv_id, '</li></ul></li></ol><table><thead><tr><th>role</th><th>turn</th></tr></thead><tbody><tr><td>', role, '</td><td>', turn,
 '</td></tr></tbody></table><table><tr><th>a</th><td>b</td></tr><tr><td>', turn, '</td><td>&lt;x&gt;</td></tr></table><pre><code class="language-Python">x = ', turn, chr(10), chr(10), '</code></pre><blockquote>said  ', role, '</blockquote><ul><li>only</li></ul>', case when turn % 2 = 0 then concat('<div data-testid="file-attachment" data-filename="f', turn, '.png" data-file-id="id', turn, '">f</div><img alt="Generated cat">') else '' end)"""
_TEXT = """concat('Turn ', turn, ' of ', conv_id, N, role, N, '1. first ', turn, chr(10), '2. second', chr(10), '  3. inner ', conv_id, N, 'role | turn', chr(10), '--- | ---', chr(10), role, ' | ', turn, N, 'a | b', chr(10), '--- | ---', chr(10), turn, ' | <x>', N, '```python', chr(10), 'x = ', turn, chr(10), '```', N, 'said ', role, N, '- only', case when turn % 2 = 0 then concat(N, 'f') else '' end)""".replace("N", "chr(10), chr(10)")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bodies(table(spark, sf_dir, "conversations").select(F.expr(_KEY).alias("key"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conversation"), F.expr(_HTML).alias("html")))


@query(f"select {_KEY} as key, sha256({_TEXT}) as text_sha256, case when turn % 2 = 0 then 9 else 8 end as parts from conversations")
def body_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text that keeps code, tables and lists readable."""
    return _bodies(spark, sf_dir).select("key", F.sha2("text", 256).alias("text_sha256"), F.size("parts").alias("parts"))


_STRUCTURED = [
    ("text", "concat('Turn ', turn, ' of ', conv_id)", "'{}'"), ("heading", "role", """'{"level":2}'"""),
    ("list", "concat('first ', turn, 'secondinner ', conv_id)", """concat('{"items":[{"depth":0,"text":"first ', turn, '"},{"depth":0,"text":"second"},{"depth":1,"text":"inner ', conv_id, '"}],"ordered":true}')"""),
    ("table", "concat('roleturn', role, turn)", """concat('{"headers":["role","turn"],"rows":[["', role, '","', turn, '"]]}')"""), ("table", "concat('ab', turn, '<x>')", """concat('{"headers":["a","b"],"rows":[["', turn, '","<x>"]]}')"""),
    ("code", "concat('x = ', turn)", "'{}'"), ("quote", "concat('said ', role)", "'{}'"), ("list", "'only'", """'{"items":[{"depth":0,"text":"only"}],"ordered":false}'"""),
]


@query(" union all ".join(f"select {_KEY} as key, {k} as part, '{kind}' as kind, '{'python' if kind == 'code' else ''}' as language, {text} as text, {structured} as structured from conversations" for k, (kind, text, structured) in enumerate(_STRUCTURED)) + f" union all select {_KEY}, 8, 'text', '', 'f', '{{}}' from conversations where turn % 2 = 0")
def body_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list or a table is one part with its structure."""
    p = _bodies(spark, sf_dir).select("key", F.explode("parts").alias("x"))
    return p.select("key", F.col("x.index").alias("part"), "x.kind", "x.language", "x.text", "x.structured")


@query(f"select {_KEY} as key, case when turn % 2 = 0 then concat('dom-c', conv_id, '-id', turn, ',gen-c', conv_id, '-Generated cat') else '' end as attachments from conversations")
def body_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("key", F.array_join("attachments", ",").alias("attachments"))


#: What a client may send as markup, and what is stored of it; every seventh turn sends nothing.
_SENT = """concat('<!-- note --><h2 class="t" style="x">', role, '</h2><p onclick="x()" dir="ltr">Turn <u>', turn, '</u> &amp; &lt;i&gt;</p><script>evil(', turn, ')</script><a href="java&#115;cript:alert(1)" rel="r">bad</a>
<a href="https://e.org/', conv_id, '?a=1&amp;b=2" onmouseover="y" target="_blank">ok</a><iframe src="z">in</iframe><img src="/i', turn, '.png" alt="i" onerror="y"><img src="data:text/html,x"><svg onload="z"><dl><dt>', conv_id, '</dt></dl></svg>
<ol start="3" value="2"><li>one<li>two</ol><pre data-language="sql"><code class="c">select 1 < 2</code></pre><table><tr><td colspan="2" width="9">vbscript:', turn, '</td></tr></table></em><b>open')"""
_KEPT = """concat('<h2 class="t">', role, '</h2><p dir="ltr">Turn <u>', turn, '</u> &amp; &lt;i&gt;</p>evil(', turn, ')<a rel="r">bad</a>
<a href="https://e.org/', conv_id, '?a=1&amp;b=2" target="_blank">ok</a>in<img src="/i', turn, '.png" alt="i"><img><dl><dt>', conv_id, '</dt></dl>
<ol start="3"><li>one<li>two</li></li></ol><pre data-language="sql"><code class="c">select 1 &lt; 2</code></pre><table><tr><td colspan="2">', turn, '</td></tr></table><b>open</b>')"""


@query(f"select {_KEY} as key, case when turn % 7 = 6 then '' else {_KEPT} end as markup from conversations")
def stored_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole markup that is stored of each submission ('' for none)."""
    sent = F.when(F.col("turn") % 7 != 6, F.expr(_SENT))
    kept = with_sanitised(table(spark, sf_dir, "conversations").select(F.expr(_KEY).alias("key"), sent.alias("html")))
    return kept.select("key", F.coalesce("sanitised", F.lit("")).alias("markup"))


#: Submissions: each turn with one field spoilt, by a number that goes round. Column -> (sound value, {number: spoilt value}).
FIELDS = {
    "key": ("concat('capture:', conv_id, '-', turn)", {1: "'short'", 2: "repeat('k', 129)", 3: "'bad key!!'"}),
    "conversation": ("concat('c', conv_id)", {4: "''", 5: "repeat('c', 256)", 6: "concat('c/', conv_id)"}),
    "message": ("concat('m', turn)", {7: "'m 1'", 8: "cast(null as {string})"}),
    "sender": ("role", {9: "'robot'"}),
    "sequence": ("turn", {10: "-1"}),
    "text_size": ("length(text)", {11: "1000001"}),
    "html_size": ("0", {12: "2000001"}),
    "parts": ("1", {13: "501"}),
    "part_kind": ("'text'", {14: "'song'", 15: "'code'"}),
    "part_text": ("'x'", {15: "''"}),
    "citations": ("0", {16: "101"}),
    "citation_url_size": ("10", {17: "2049"}),
    "status": ("'complete'", {18: "'done'", 19: "'partial'"}),
    "branch": ("'main'", {20: "repeat('b', 65)"}),
    "author": ("'me'", {21: "repeat('a', 129)"}),
    "digest": ("{sha}", {22: "'ABC'", 23: "repeat('0', 64)"}),
    "attachments": ("0", {24: "21"}),
    "workspace": ("'business'", {25: "'personal'"}),
    "extra": ("''", {26: "'unknown_field'"}),
    "shown": ("'en'", {27: "repeat('e', 40)"}),
}
ROUND = 28
#: Kinds of parts.
PART_KINDS = ["text", "code", "heading", "list", "table", "quote", "link", "citation", "image_ref", "attachment_ref", "tool_output", "unknown"]
#: Field rules, then rules between fields, in order. {like} is the engine's full match.
FIELD_RULES = {
    "bad_key": "length(key) < 8 or length(key) > 128 or not {like}(key, '^[A-Za-z0-9._:-]+$')",
    "bad_conversation": "length(conversation) not between 1 and 255 or not {like}(conversation, '^[A-Za-z0-9._:@-]+$')",
    "bad_message": "message is not null and (length(message) > 255 or not {like}(message, '^[A-Za-z0-9._:@-]+$'))",
    "bad_role": "sender not in ('user', 'assistant', 'tool', 'system')",
    "bad_sequence": "sequence < 0",
    "text_too_long": "text_size > 1000000",
    "html_too_long": "html_size > 2000000",
    "too_many_parts": "parts > 500",
    "bad_part_kind": "part_kind not in (" + ", ".join(map(repr, PART_KINDS)) + ")",
    "too_many_citations": "citations > 100",
    "citation_url_too_long": "citation_url_size > 2048",
    "bad_status": "status not in ('complete', 'partial', 'reconciled', 'unknown')",
    "branch_too_long": "length(branch) > 64",
    "author_too_long": "length(author) > 128",
    "bad_digest": "not {like}(digest, '^[0-9a-f]{{64}}$')",
    "too_many_attachments": "attachments > 20",
    "unknown_field": "extra <> ''",
    "locale_too_long": "length(shown) > 35",
}
CROSS_RULES = {"code_without_text": "part_kind = 'code' and part_text = ''", "partial_user": "status = 'partial' and sender = 'user'", "personal_workspace": "workspace = 'personal'", "checksum_mismatch": "digest <> {sha}"}
BATCH = 100


def _sql(engine: dict[str, str]) -> tuple[list[str], str, str]:
    """The submissions' columns, the list of broken field rules, and the first broken rule between fields, for one engine."""
    columns = [f"case (turn * 5 + conv_id) % {ROUND} " + " ".join(f"when {k} then {v.format(**engine)}" for k, v in spoilt.items()) + f" else {sound.format(**engine)} end as {name}" for name, (sound, spoilt) in FIELDS.items()]
    broken = "concat_ws(',', " + ", ".join(f"case when {rule.format(**engine)} then '{name}' end" for name, rule in FIELD_RULES.items()) + ")"
    cross = "case " + " ".join(f"when {rule.format(**engine)} then '{name}'" for name, rule in CROSS_RULES.items()) + " else '' end"
    return ["conv_id", "turn", "text", *columns], broken, cross


_DUCK = _sql({"string": "varchar", "sha": "sha256(text)", "like": "regexp_matches"})
_SPARK = _sql({"string": "string", "sha": "sha2(text, 256)", "like": "regexp_like"})


@query(f"""with s as (select {', '.join(_DUCK[0])} from conversations), f as (select *, {_DUCK[1]} as fields from s), r as (select conv_id, turn, case when fields <> '' then fields else {_DUCK[2]} end as errors from f),
 b as (select conv_id, count(*) as size from conversations group by conv_id)
 select r.conv_id, turn, case when size > {BATCH} then 'batch_too_large' else errors end as errors, case when size > {BATCH} then 'aborted' when errors = '' then 'accepted' else 'rejected' end as outcome from r join b using (conv_id)""")
def validated_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field's rule, then those between fields for what has none broken; a batch (a conversation's turns) of more than a
    hundred is refused whole. One scan, but for the batches' sizes."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.selectExpr(*_SPARK[0]).withColumn("fields", F.expr(_SPARK[1])).withColumn("errors", F.expr(f"case when fields <> '' then fields else {_SPARK[2]} end"))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    large = F.col("size") > BATCH
    outcome = F.when(large, "aborted").when(F.col("errors") == "", "accepted").otherwise("rejected")
    return rows.join(sizes, "conv_id").select("conv_id", "turn", F.when(large, "batch_too_large").otherwise(F.col("errors")).alias("errors"), outcome.alias("outcome"))

