"""Rendered transcripts, as pages made from conversations and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transcripts import read_transcripts, read_workspaces, submissions
from ..sources.tables import table
from .registry import query

_ROLE = "case when (conv_id + turn) % 9 = 7 then 'critic' else role end"
_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
#: A turn as it is rendered: attributes on the turn or below, a list without ends, links that are citations and one that is none.
_TURN = f"""concat('<article data-testid="conversation-turn-', turn, '"', if(turn % 4 = 3, ' data-is-streaming="true"', ''), if(role = 'assistant', concat(' data-message-model-slug="m', turn % 3, '"'), ''), if(turn % 3 = 0, concat(' data-author-name="u', conv_id, '"'), ''), '>',
 if(turn % 3 = 1, concat('<time datetime="2026-01-0', 1 + turn % 5, 'T03:04:05Z"></time>'), ''), '<div data-message-author-role="', {_ROLE}, '"', if(turn % 2 = 0, concat(' data-message-id="m', conv_id, '-', turn, '"'), ''), '>',
 case role when 'assistant' then concat('<div class="x markdown"><p>', {_ESCAPED}, '<ul><li>first ', turn, '<li>then</ul><p><a data-citation="s', turn, '" href="HTTPS://e.org/', conv_id, '">Ref  one</a><a data-citation href="/in">in</a><a data-citation href="http://e.org">two</a><a href="https://no.org">no</a></p></div>')
  when 'user' then concat('<div class="whitespace-pre-wrap">', {_ESCAPED}, '</div>') else concat('<div data-message-content><h3>System</h3><p>', {_ESCAPED}, '</p></div>') end, '</div>',
 if(turn % 5 = 2, '<span class="small tabular-nums"> 2 /3 </span>', ''), if(turn % 4 = 0, concat('<div data-testid="file-attachment" data-filename="f', turn, '.png" data-file-id="id', turn, '"></div>'), ''), '</article>')"""
#: What is around the turns: for every third conversation a form around all of it, and always a form in which something is being written.
_BEFORE = """concat('<nav><a href="/">Home</a><a aria-current="page"> Talk  ', conv_id, '</a></nav><main>', if(conv_id % 3 = 0, '<form><div>', ''))"""
_AFTER = """concat(if(conv_id % 3 = 0, '</div></form>', ''), '</main><form><textarea>secret draft</textarea><p>draft</p></form><div contenteditable="true"><article data-testid="conversation-turn-98"><div data-message-author-role="user">draft</div></article></div>')"""
_URL = "concat('https://chat.e.org/', if(conv_id % 4 = 3, 'new', concat('c/', lpad(hex(conv_id), 16, '0'))))"

_TEXT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_CONVERSATION = "case when conv_id % 4 <> 3 then lpad(hex(conv_id), 16, '0') end"


@query(
    f"""with t as (select *, {_CONVERSATION} as conversation, case role when 'assistant' then {_TEXT} || E'\\n\\n- first ' || turn || E'\\n- then\\n\\nRef oneintwono' when 'user' then {_TEXT} else E'System\\n\\n' || {_TEXT} end as body from conversations where (conv_id + turn) % 9 <> 7),
 k as (select * from t where trim(body) <> '')
 select conv_id, coalesce(conversation, '') as conversation, 'Talk ' || conv_id as title, coalesce(first_value(case when role = 'assistant' then 'm' || turn % 3 end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following), '') as page_model,
  turn as position, row_number() over (partition by conv_id order by turn) - 1 + conv_id as sequence_index, case when turn % 2 = 0 then 'm' || conv_id || '-' || turn else '' end as message_id, role, case when turn % 3 = 0 then 'u' || conv_id else '' end as author, case when turn % 4 = 3 then 'partial' else 'complete' end as completion_status,
  case when turn % 3 = 1 then epoch(make_timestamp(2026, 1, 1 + turn % 5, 3, 4, 5))::bigint else -1 end as created, case when turn % 5 = 2 then 'branch-2-of-3' else '' end as branch_key, case when role = 'assistant' then '0|Ref one|HTTPS://e.org/' || conv_id || '|s' || turn || ',2|two|http://e.org|' else '' end as citations,
  case when turn % 4 = 0 then 'dom-' || coalesce(conversation, 'unknown') || '-id' || turn else '' end as attachments, sha256(body) as text_sha256, sha256(replace(lower(trim(regexp_replace(body, '\\s+', ' ', 'g'))), 'ß', 'ss')) as content_sha256 from k"""
)
def transcript_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of rendered conversations as they are submitted, numbered from the conversation's own start."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_TURN).alias("markup"))
    pages = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "markup"))).alias("x"))  # a page is one conversation
    html = F.concat(F.expr(_BEFORE), F.array_join(F.transform("x", lambda t: t["markup"]), ""), F.expr(_AFTER))
    read = read_transcripts(pages.select(F.col("conv_id").cast("string").alias("key"), F.expr(_URL).alias("url"), html.alias("html")))
    m = submissions(read, F.col("key").cast("long")).withColumn("conv_id", F.col("key").cast("long")).join(read.select("key", "title", F.col("model").alias("page_model")), "key")
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws("|", c["index"].cast("string"), F.coalesce(c["title"], F.lit("")), c["url"], F.coalesce(c["source_id"], F.lit("")))), ",")
    named = {c: F.coalesce(c, F.lit("")) for c in ("conversation", "page_model", "message_id", "author", "branch_key")}
    return m.withColumns(named).select(
        "conv_id", "conversation", "title", "page_model", F.col("position").cast("long").alias("position"), "sequence_index", "message_id", "role", "author", "completion_status", F.coalesce(F.unix_seconds("source_created_at"), F.lit(-1)).alias("created"), "branch_key",
        cited.alias("citations"), F.array_join("attachments", ",").alias("attachments"), F.sha2("text", 256).alias("text_sha256"), "content_sha256",
    )


#: A customer's page: whether it names its workspace, and how, goes by the customer's number.
_PAGE = """concat('<header>', case c_custkey % 5 when 0 then concat('<button data-testid="accounts-profile-button"></button><button data-testid="accounts-profile-button" aria-label="', c_name, if(c_custkey % 2 = 0, ' Enterprise', ' Free'), '"><div class="truncate a"> ', c_name, '</div></button>')
 when 1 then concat('<p data-testid="workspace-name"><b>', c_name, '</b>  Ltd</p>') when 2 then concat('<nav><div data-testid="workspace-switcher" data-workspace-id=" w', c_custkey, ' "><span>', c_name, '</span></div></nav>') when 3 then '<i data-workspace-name></i><i data-workspace-id=" "></i>' else '' end, '</header>',
 if(c_custkey % 7 = 0, '<i data-managed-account="true">', ''), if(c_custkey % 11 = 0, '<i data-workspace-kind="personal">', ''))"""
_PAGE_URL = "concat('https://chat.e.org', if(c_custkey % 3 = 0, '/g/g-1/c/x', '/c/x?r=/g/g-2'))"


@query(
    """with w as (select c_custkey, case c_custkey % 5 when 0 then c_name when 1 then c_name || ' Ltd' when 2 then c_name end as label, case when c_custkey % 5 = 2 then 'w' || c_custkey end as id, c_custkey % 7 = 0 or c_custkey % 10 = 0 as managed from customer)
 select c_custkey, coalesce(label, '') as label, coalesce(id, '') as workspace_id, array_to_string(list_filter([case when label is not null then 'workspace_label_match' end, case when id is not null then 'workspace_id_match' end, case when managed then 'enterprise_workspace_marker' end,
  case when c_custkey % 3 = 0 then 'managed_account_url_path' end], lambda x: x is not null), ',') as signals, c_custkey % 11 = 0 as personal from w"""
)
def workspace_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages say of their workspaces: a hint, on which `workspace_decisions` has rules."""
    # Customers are short and their pages take long: over all cores, however few files or groups of rows the table has.
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(4 * spark.sparkContext.defaultParallelism)
    pages = customers.select(F.col("c_custkey").cast("string").alias("key"), F.expr(_PAGE_URL).alias("url"), F.expr(_PAGE).alias("html"))
    w = read_workspaces(pages).select(F.col("key").cast("long").alias("c_custkey"), "workspace.*")
    return w.select("c_custkey", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("workspace_id", F.lit("")).alias("workspace_id"), F.array_join("signals", ",").alias("signals"), "personal")
