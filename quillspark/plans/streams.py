"""Pages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bodies import read_pages
from ..operators.markup import strict_markup
from ..sources.tables import epoch, table
from ..streaming import events as S
from ..streaming.stability import rocks, stable
from .registry import query
from .sql import EPOCH

_E = EPOCH.format("ts")


#: The given pages' blocks, in SQL: a menu, a notice, an article's heading and paragraphs (some never closed), a footer.
_PLAIN = lambda x: f"""trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&copy;', '\xa9'), '&middot;', '\xb7'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '\x01', 'g'), '\x01', '&'), '\\s+', ' ', 'g'))"""
_BLOCKS = f"""p as (select page_id, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<!--.*?-->', '', 'g'), '<(ul|div class="ad"|h1|p|footer)>', '\x02<\\1>', 'g'), '\x02')) as b, generate_subscripts(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<!--.*?-->', '', 'g'), '<(ul|div class="ad"|h1|p|footer)>', '\x02<\\1>', 'g'), '\x02'), 1) as k from pages),
 t as (select page_id, k, case when starts_with(b, '<ul>') then 'list' when starts_with(b, '<h1>') then 'heading' else 'text' end as kind, {_PLAIN("b")} as text, list_transform(regexp_extract_all(b, '(?s)<li>(.*?)</li>', 1), lambda i: {_PLAIN("i")}) as items from p),
 n as (select *, cast(row_number() over (partition by page_id order by k) - 1 as int) as i from t where text <> '')"""


@query(f"""with {_BLOCKS} select page_id, i as "index", kind, '' as language, case kind when 'heading' then '{{"level":1}}' when 'list' then '{{"items":[' || array_to_string(list_transform(items, lambda x: '{{"depth":0,"text":' || to_json(x) || '}}'), ',') || '],"ordered":false}}' else '{{}}' end as structured, sha256(text) as text_sha256 from n""")
def html_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of whole pages; a list or a table is one with its structure."""
    p = read_pages(table(spark, sf_dir, "pages")).select("page_id", F.explode("parts").alias("x"))
    return p.select("page_id", "x.index", "x.kind", "x.language", "x.structured", F.sha2("x.text", 256).alias("text_sha256"))


@query(f"""with {_BLOCKS}, w as (select page_id, string_agg(case kind when 'list' then '- ' || array_to_string(items, E'\n- ') else text end, E'\n\n' order by i) as text from n group by page_id)
 select page_id, cast(length(coalesce(text, '')) as int) as chars, sha256(coalesce(text, '')) as text_sha256 from pages left join w using (page_id)""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(table(spark, sf_dir, "pages")).select("page_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


@query("select page_id, 0 as scripts, 0 as handlers from pages")
def sanitize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must never be left in safe markup, counted."""
    p = strict_markup(table(spark, sf_dir, "pages"))
    return p.select("page_id", F.regexp_count("safe_html", F.lit("(?i)<script|<iframe|javascript:")).alias("scripts"), F.regexp_count("safe_html", F.lit(r"(?i)<[^>]*\son[a-z]+\s*=")).alias("handlers"))


@query(f"""select page_id, {_PLAIN("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} as title, cast(len(u) as int) as links, array_to_string(u, ' ') as urls from (select page_id, html, regexp_extract_all(html, '<a [^>]*href="(https?:[^"]*)"', 1) as u from pages)""")
def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, and links that leave the page's site or name it in full; nulls for a page without markup."""
    p = read_pages(table(spark, sf_dir, "pages"))
    of = lambda x, name: F.when(F.col("given"), x).alias(name)
    return p.select("page_id", of(F.col("title"), "title"), of(F.size("links"), "links"), of(F.array_join("links", " "), "urls"))


@query(r"select doc_id, len(t) as tokens, sha256(array_to_string(t, ' ')) as tokens_sha256 from (select doc_id, list_sort(list_distinct(regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')), '[a-z0-9]+'))) as t from documents)")
def fulltext_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lower-case ASCII lexemes of each document."""
    ascii_ = F.lower(F.regexp_replace("text", r"[^\x00-\x7F]", " "))
    t = table(spark, sf_dir, "documents").select("doc_id", F.sort_array(F.array_distinct(F.regexp_extract_all(ascii_, F.lit("([a-z0-9]+)"), 1))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query("select event_id, user_id, event_type from events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice, as overlapping pulls deliver it, and is admitted once."""
    return S.drained(S.admitted_once(S.stream_of(spark, sf_dir, times=2))).select("event_id", "user_id", "event_type")


@query(f"with r as (select {_E} - {_E} % 3600 as start, event_type, count(*) as n from events group by all) select * from r where start + 3600 <= (select max({_E}) - 600 from events)")
def stream_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are closed: those that end at the watermark or before it."""
    return S.drained(S.minute_rates(S.stream_of(spark, sf_dir)))


@query(f"""with e as (select event_id, user_id, {_E} as t from events), g as (select *, case when t - lag(t) over w > 21600 then 1 else 0 end as new from e window w as (partition by user_id order by t, event_id)),
 s as (select *, sum(new) over (partition by user_id order by t, event_id rows unbounded preceding) as session from g)
 select user_id, min(t) as first_at, max(t) as last_at, count(*) as n from s group by user_id, session""")
def quiet_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events that end once a user was quiet for more than six hours."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", epoch("ts").alias("at"))
    by = Window.partitionBy("user_id").orderBy("at", "event_id")
    new = F.when(F.col("at") - F.lag("at").over(by) > 21600, 1).otherwise(0)
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n")).drop("session")


#: Milliseconds of a quiet time. Of the events table a user is a conversation and a type of event a message.
QUIET = 3 * 3600 * 1000


@query(f"""with o as (select user_id, event_id, epoch_us(ts) // 1000 as ms, event_type as identity, sha256(props) as signature, event_id % 4 = 0 as streaming, event_id % 13 = 0 as hidden from events),
 n as (select *, lead(ms) over (partition by user_id order by ms, event_id) as next_ms from o), closed as (select max(ms) - 600001 as until from o),
 l as (select user_id, ms + {QUIET} * k as look from n, (values (1), (2)) t(k), closed where not hidden and (next_ms is null or ms + {QUIET} * k < next_ms) and ms + {QUIET} * k <= until),
 s as (select l.user_id, look, identity, arg_max(signature, row(ms, event_id)) as signature, arg_max(streaming, row(ms, event_id)) as streaming from l join o on o.user_id = l.user_id and not hidden and ms <= look group by all),
 c as (select *, coalesce(signature <> lag(signature) over w, true)::int as new from s window w as (partition by user_id, identity order by look)),
 g as (select *, sum(new) over (partition by user_id, identity order by look) as run from c), p as (select *, row_number() over (partition by user_id, identity, run order by look) as place from g),
 r as (select user_id, identity, run, min(signature) as signature, min(look) as tracked, min(look) filter (place > 1 and not streaming) as done from p group by all),
 x as (select *, lead(tracked) over (partition by user_id, identity order by run) as next_run from r),
 f as (select x.user_id, x.identity, x.run, any_value(x.signature) as signature, any_value(done) as done, any_value(next_run) as next_run, min(ms) as gone from x left join (select user_id, ms from o, closed where hidden and ms <= until) h on h.user_id = x.user_id and h.ms > x.tracked group by all)
 select user_id as conversation, identity, signature, case when done is not null and (gone is null or done < gone) then 'complete' else 'partial' end as status, case when done is not null and (gone is null or done < gone) then done else gone end as ms
 from f where (done is not null and (gone is null or done < gone)) or (gone is not null and (next_run is null or gone < next_run))""")
def stable_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages given out once each: complete after two looks that find the same, or partial when their conversation goes out of sight."""
    events = S.timed(S.stream_of(spark, sf_dir))
    seen = events.select(
        F.col("user_id").cast("string").alias("conversation"), "at", F.unix_millis("at").alias("ms"), F.col("event_id").alias("sequence"), F.col("event_type").alias("identity"), F.sha2("props", 256).alias("signature"),
        (F.col("event_id") % 4 == 0).alias("streaming"), (F.col("event_id") % 13 == 0).alias("hidden"),
    )
    with rocks(spark):
        given = S.drained(stable(seen, QUIET))
    return given.withColumn("conversation", F.col("conversation").cast("long"))


#: A page with what must go and what may stay, and what is left of it, in SQL that both engines read.
_HOSTILE = """concat('<h2 style="x">', role, '</h2><p onclick="x()">Turn <b>', turn, '</b> &lt;i&gt;</p><script>evil(', turn, ')</script><a href="javascript:alert(1)">bad</a><a href="https://e.org/', conv_id, '" onmouseover="y" title="t">ok</a><iframe src="z">no</iframe><svg onload="z"><p>in</p></svg><ul><li>', conv_id, '</li></ul><img src="x" onerror="y">')"""
_SAFE = """concat('<h2>', role, '</h2><p>Turn <b>', turn, '</b> &lt;i&gt;</p><a>bad</a><a href="https://e.org/', conv_id, '" title="t">ok</a><ul><li>', conv_id, '</li></ul>')"""


@query(f"select conv_id * 1000 + turn as page_id, {_SAFE} as safe_html, concat('https://e.org/', conv_id) as links from conversations")
def safe_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hostile pages made from turns: the whole markup that is left, and the links."""
    pages = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), F.expr(_HOSTILE).alias("html"))
    return strict_markup(pages).select("page_id", "safe_html", F.array_join("links", " ").alias("links"))
