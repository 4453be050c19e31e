"""The remaining operators: attachments, policy, lookups, collections, clients, partitions, archives and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.text import bucket, pseudonym
from ..operators import capture as C
from ..sources.sinks import gzip_json_lines
from ..sources.tables import epoch, table
from ..streaming.events import scratch
from .registry import query
from .sql import EPOCH, LOG

_E = EPOCH.format("ts")


@query("""select d.doc_id, case when l.doc_id is null then 'expired' when d.n_chars > 20000 then 'rejected_size' when l.toxic = 1 then 'quarantine' when d.lang not in ('en', 'de') then 'metadata_only' else 'clean' end as state,
 case when l.doc_id is null then 'no_upload' when d.n_chars <> length(d.text) then 'size_mismatch' else 'ok' end as verdict from documents d left join labels l on d.doc_id = l.doc_id""")
def attachment_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared facts (documents) against observed ones (labels): the first rule that holds decides."""
    d = table(spark, sf_dir, "documents")
    seen = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(True).alias("seen"))
    j = d.join(seen, "doc_id", "left")
    missing = F.col("seen").isNull()
    state = F.when(missing, "expired").when(F.col("n_chars") > 20000, "rejected_size").when(F.col("toxic") == 1, "quarantine").when(~F.col("lang").isin("en", "de"), "metadata_only").otherwise("clean")
    verdict = F.when(missing, "no_upload").when(F.col("n_chars") != F.length("text"), "size_mismatch").otherwise("ok")
    return j.select("doc_id", state.alias("state"), verdict.alias("verdict"))


@query("""select c_custkey, case when c_acctbal < 0 then 'disabled' when c_mktsegment = 'HOUSEHOLD' then 'personal_workspace' when c_nationkey > 20 then 'not_allowed'
 when c_custkey % 3 = 0 and c_custkey % 5 = 0 then 'verified' when c_custkey % 3 = 0 or c_custkey % 5 = 0 then 'weak_signal' else 'unverified' end as decision from customer""")
def workspace_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules, first failure wins; strong signals are an intersection of what was seen with what is needed."""
    seen = F.filter(F.array(F.when(F.col("c_custkey") % 3 == 0, "domain"), F.when(F.col("c_custkey") % 5 == 0, "id")), lambda x: x.isNotNull())
    strong = F.size(F.array_intersect(seen, F.array(F.lit("domain"), F.lit("id"))))
    rule = F.when(F.col("c_acctbal") < 0, "disabled").when(F.col("c_mktsegment") == "HOUSEHOLD", "personal_workspace").when(F.col("c_nationkey") > 20, "not_allowed").when(strong == 2, "verified").when(strong == 1, "weak_signal").otherwise("unverified")
    return table(spark, sf_dir, "customer").select("c_custkey", rule.alias("decision"))


@query("""with u as (select conv_id, max(turn) filter (role = 'user') as latest_user, min(turn) filter (role = 'assistant') as first_answer from conversations group by conv_id)
 select a.conv_id, a.turn, coalesce(p.turn, u.latest_user, -1) as anchor, coalesce(u.first_answer, -1) as first_answer from conversations a
 left join conversations p on p.conv_id = a.conv_id and p.turn = a.turn - 1 and p.role = 'user' left join u on u.conv_id = a.conv_id where a.role = 'assistant'""")
def first_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact match where there is one, else the latest user turn; both from one window over the conversation."""
    whole, ordered = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("turn")
    user = lambda x: F.when(F.col("role") == "user", x)
    before = F.when((F.lag("role").over(ordered) == "user") & (F.lag("turn").over(ordered) == F.col("turn") - 1), F.lag("turn").over(ordered))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    c = c.withColumns({"exact": before, "latest_user": F.max(user(F.col("turn"))).over(whole), "first_answer": F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(whole)})
    return c.where("role = 'assistant'").select("conv_id", "turn", F.coalesce("exact", "latest_user", F.lit(-1)).alias("anchor"), F.coalesce("first_answer", F.lit(-1)).alias("first_answer"))


@query("""select source, min(doc_id) as doc_id, count(*) as links from (select d.source, d.doc_id from documents d join labels l on d.doc_id = l.doc_id where l.toxic = 0) group by source""")
def attachment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links joined to their attachments; of each source its first, and how many there are."""
    links = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id"), "doc_id")
    return links.groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("links"))


@query("""with k as (select c_mktsegment || '/' || c_nationkey as workspace, min(c_custkey) as first_user, count(*) as users from customer group by 1)
 select workspace, substr(sha256(lower(workspace)), 1, 32) as workspace_hash, first_user, users, users >= 2 as shared from k""")
def get_or_create_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string"))
    k = table(spark, sf_dir, "customer").groupBy(key.alias("workspace")).agg(F.min("c_custkey").alias("first_user"), F.count("*").alias("users"))
    return k.select("workspace", F.substring(F.sha2(F.lower("workspace"), 256), 1, 32).alias("workspace_hash"), "first_user", "users", (F.col("users") >= 2).alias("shared"))


@query("select o_orderkey, coalesce(nullif(case when o_orderkey % 4 = 0 then '' else o_orderpriority end, ''), c_mktsegment) as label, coalesce(nullif(c_name, ''), 'unnamed') as owner, o_totalprice > 100000 and c_acctbal >= 0 as verified from orders join customer on c_custkey = o_custkey")
def coalesced_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither null nor empty ever wins over a value."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    given = F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.col("o_orderpriority"))
    return j.select("o_orderkey", F.coalesce(F.nullif(given, F.lit("")), "c_mktsegment").alias("label"), F.coalesce(F.nullif("c_name", F.lit("")), F.lit("unnamed")).alias("owner"), ((F.col("o_totalprice") > 100000) & (F.col("c_acctbal") >= 0)).alias("verified"))


@query(f"""with {LOG}, b as (select conv_id, 'branch-' || (rank % 3 + 1) || '-of-3' as branch_key, rank % 2 = 0 as selected, arrival from admitted)
 select conv_id, branch_key, cast(regexp_extract(branch_key, 'branch-(\\d+)-of-(\\d+)', 1) as int) as branch_index, arg_max(selected, arrival) as is_selected, count(*) as captures from b group by conv_id, branch_key""")
def branch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches named from their counter; whether one is selected is the last word on it."""
    counter = F.concat((F.col("rank") % 3 + 1).cast("string"), F.lit(" / 3"))
    part = lambda k: F.regexp_extract(counter, r"(\d+)\s*/\s*(\d+)", k)
    b = C.admitted(C.capture_log(spark, sf_dir)).select("conv_id", F.concat(F.lit("branch-"), part(1), F.lit("-of-"), part(2)).alias("branch_key"), part(1).cast("int").alias("branch_index"), (F.col("rank") % 2 == 0).alias("selected"), "arrival")
    return b.groupBy("conv_id", "branch_key", "branch_index").agg(F.max_by("selected", "arrival").alias("is_selected"), F.count("*").alias("captures"))


@query("""select conv_id, turn, cast(i - 1 as int) as part_index, sha256(part) as part_sha256, cast(length(part) as bigint) as size from (
  select conv_id, turn, unnest(range(1, len(p) + 1)) as i, unnest(p) as part from (select conv_id, turn, string_split(text, '.')[1:500] as p from conversations))""")
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 parts of each turn, in order."""
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.slice(F.split("text", r"\."), 1, 500)).alias("part_index", "part"))
    return p.select("conv_id", "turn", "part_index", F.sha2("part", 256).alias("part_sha256"), F.length("part").cast("long").alias("size"))


@query("""with f as (select event_id % 1000 as client_feedback_id, event_id, user_id, cast(event_id % 5 + 1 as bigint) as rating from events where event_type = 'click'),
 w as (select *, row_number() over (partition by client_feedback_id order by event_id) as place from f)
 select w.client_feedback_id, w.event_id, w.user_id, w.rating, coalesce(l.quality, -1) as quality from w left join labels l on l.doc_id = w.client_feedback_id where place = 1""")
def feedback_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first feedback with a client id wins; the message it names may be missing."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select((F.col("event_id") % 1000).alias("client_feedback_id"), "event_id", "user_id", (F.col("event_id") % 5 + 1).alias("rating"))
    first = e.groupBy("client_feedback_id").agg(F.min(F.struct("event_id", "user_id", "rating")).alias("x")).select("client_feedback_id", "x.*")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("client_feedback_id"), "quality")
    return first.join(labels, "client_feedback_id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query(f"select event_type, count(*) as n, count(distinct user_id) as users, count(*) filter ({_E} >= 1706486400 and event_type <> 'error') as active, count(*) filter (props <> '{{}}') as with_props from events group by event_type")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = (epoch("ts") >= 1706486400) & (F.col("event_type") != "error")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(active).alias("active"), F.count_if(F.col("props") != "{}").alias("with_props"))


@query("""with a as (select 'newest' as list, row_number() over (order by ts desc, event_id) as place, event_id from events), b as (select 'by_type' as list, row_number() over (order by event_type, ts, event_id) as place, event_id from events),
 c as (select 'by_error_value' as list, row_number() over (order by case when event_type = 'error' then value end nulls last, event_id) as place, event_id from events)
 select list, cast(place as int) as place, event_id from (select * from a union all select * from b union all select * from c) where place <= 50""")
def sort_limit_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k lists: each sort keeps only its k first rows, which then are numbered."""
    e = table(spark, sf_dir, "events").withColumn("error_value", F.when(F.col("event_type") == "error", F.col("value")))
    orders = {"newest": [F.desc("ts"), "event_id"], "by_type": ["event_type", "ts", "event_id"], "by_error_value": [F.asc_nulls_last("error_value"), "event_id"]}
    out = None
    for name, by in orders.items():
        top = e.orderBy(*by).limit(50).select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*by)).alias("place"), "event_id")
        out = top if out is None else out.unionByName(top)
    return out


@query(r"""select page_id, 'k-' || substr(sha256(coalesce(url, '') || '|' || page_id), 1, 40) as client_key, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) as last_number, regexp_extract(url, '^https?://([^/]+)', 1) as host,
 starts_with(url, 'https://') as is_https, cast(strlen('{"page_id":' || page_id || '}') as bigint) as json_bytes, substr(url, 1, 30) as short_url,
 len(regexp_replace(trim(regexp_replace(regexp_replace(html, '[ \t]+\n', E'\n', 'g'), E'\n{3,}', E'\n\n', 'g')), ' ', '', 'g')) as folded_chars from pages""")
def string_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    folded = F.trim(F.regexp_replace(F.regexp_replace("html", r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    return p.select(
        "page_id", F.concat(F.lit("k-"), F.substring(F.sha2(F.concat(F.coalesce("url", F.lit("")), F.lit("|"), F.col("page_id").cast("string")), 256), 1, 40)).alias("client_key"),
        F.regexp_extract("url", r"([0-9]+)[^0-9]*$", 1).alias("last_number"), F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.startswith("url", F.lit("https://")).alias("is_https"),
        F.octet_length(F.to_json(F.struct("page_id"))).cast("long").alias("json_bytes"), F.substring("url", 1, 30).alias("short_url"), F.length(F.replace(folded, F.lit(" "), F.lit(""))).cast("long").alias("folded_chars"),
    )


@query("""with g as (select user_id, list_sort(list(distinct event_type)) as kinds, list_sort(list(event_id)) as ids from events group by user_id)
 select user_id, array_to_string(list_sort(list_intersect(kinds, ['click', 'purchase'])), ',') as strong, kinds = ['click', 'error', 'purchase', 'signup', 'view'] as has_all, cast((len(ids) - 1) // 20 + 1 as bigint) as batches, array_to_string(ids[-5:], ',') as last_ids from g""")
def collection_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersections, order-free equality, fixed-size batches and the last five of each user's events."""
    by = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    e = table(spark, sf_dir, "events").withColumn("back", F.row_number().over(by))
    g = e.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("back") <= 5, F.col("event_id")))).alias("last"))
    every = F.array(*map(F.lit, ("view", "click", "signup", "error", "purchase")))
    return g.select(
        "user_id", F.array_join(F.sort_array(F.array_intersect("kinds", F.array(F.lit("click"), F.lit("purchase")))), ",").alias("strong"), (F.sort_array("kinds") == F.sort_array(every)).alias("has_all"),
        (F.floor((F.col("n") - 1) / 20) + 1).cast("long").alias("batches"), F.array_join(F.col("last").cast("array<string>"), ",").alias("last_ids"),
    )


_FLOW = "case event_id % 6 when 0 then 200 when 1 then 429 when 2 then 503 when 3 then 400 when 4 then 200 else 500 end"


@query(f"""with f as (select event_id, user_id, {_FLOW} as http, cast(event_id % 13 as bigint) as attempts, cast(floor(value) as bigint) as size, lag(event_type) over (partition by user_id order by event_id) is distinct from event_type as changed from events)
 select user_id, count(*) as attempted, count(*) filter (http = 200) as succeeded, count(*) filter (http in (429, 500, 503) and attempts < 12) as retried, count(*) filter (http = 400 or (http in (429, 500, 503) and attempts >= 12)) as dropped,
 cast(sum(size) as bigint) as bytes, count(*) filter (changed) as changes from f group by user_id""")
def client_retry_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    http = F.expr(_FLOW)
    again = http.isin(429, 500, 503)
    changed = ~F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).eqNullSafe(F.col("event_type"))
    f = table(spark, sf_dir, "events").withColumns({"http": http, "attempts": F.col("event_id") % 13, "changed": changed})
    spent = F.col("attempts") >= 12
    return f.groupBy("user_id").agg(
        F.count("*").alias("attempted"), F.count_if(F.col("http") == 200).alias("succeeded"), F.count_if(again & ~spent).alias("retried"), F.count_if((F.col("http") == 400) | (again & spent)).alias("dropped"),
        F.sum(F.floor("value")).alias("bytes"), F.count_if("changed").alias("changes"),
    )


@query(f"""with m as (select strftime(date_trunc('month', o_orderdate), '%Y-%m-01') as month, count(*) as n from orders group by 1),
 c as (select strftime(x, '%Y-%m-01') as month, x from (select unnest(generate_series((select date_trunc('month', min(o_orderdate)) from orders), (select date_trunc('month', max(o_orderdate)) + interval 3 month from orders), interval 1 month)) as x))
 select c.month, coalesce(n, 0) as n, c.x + interval 1 month <= timestamp '1994-01-01' as drop_now, n is null as created_ahead from c left join m on m.month = c.month""")
def partition_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar of months from the first to three beyond the last, with what each holds."""
    o = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.count("*").alias("n"))
    ends = o.agg(F.min("m").alias("a"), F.max("m").alias("z"))
    calendar = ends.select(F.explode(F.sequence("a", F.add_months("z", 3), F.expr("interval 1 month"))).alias("m"))
    c = calendar.join(o, "m", "left")
    return c.select(F.date_format("m", "yyyy-MM-dd").alias("month"), F.coalesce("n", F.lit(0)).alias("n"), (F.add_months("m", 1) <= F.lit("1994-01-01").cast("date")).alias("drop_now"), F.col("n").isNull().alias("created_ahead"))


@query(f"""select user_id, event_id, cast(row_number() over (partition by user_id, event_type order by event_id) as int) as attempt_number, coalesce({_E} - lag({_E}) over (partition by user_id, event_type order by event_id), 0) as seconds_since, event_type <> 'error' as succeeded from events""")
def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", epoch("ts").alias("at"))
    return e.select("user_id", "event_id", F.row_number().over(by).alias("attempt_number"), F.coalesce(F.col("at") - F.lag("at").over(by), F.lit(0)).alias("seconds_since"), (F.col("event_type") != "error").alias("succeeded"))


@query(f"""with {LOG} select arrival, 'raw/conversation=' || conv_id || '/' || key || '.json' as object_key, sha256('{{"arrival":' || arrival || ',"conv_id":' || conv_id || ',"digest":"' || digest || '","key":"' || key || '","role":"' || role || '"}}') as object_sha256 from admitted""")
def archive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = C.hashed(C.admitted(C.capture_log(spark, sf_dir)))
    body = F.to_json(F.struct("arrival", "conv_id", "digest", "key", "role"))
    return a.select("arrival", F.concat(F.lit("raw/conversation="), F.col("conv_id").cast("string"), F.lit("/"), "key", F.lit(".json")).alias("object_key"), F.sha2(body, 256).alias("object_sha256"))


@query("select role, count(*) as n, cast(sum(length(text)) as bigint) as chars, min(conv_id) as first_conversation from conversations group by role")
def sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as gzip JSON lines with a manifest, read back whole."""
    folder = scratch(spark)
    rows = table(spark, sf_dir, "conversations").sortWithinPartitions("conv_id", "turn")
    gzip_json_lines(rows, f"{folder}/rows", ["conv_id", "turn", "role", "text"]).write.parquet(f"{folder}/manifest")
    named = [f"{folder}/rows/{r.file}" for r in spark.read.parquet(f"{folder}/manifest").select("file").collect()]
    back = spark.read.schema("conv_id long, turn long, role string, text string").json(named)
    return back.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("conv_id").alias("first_conversation"))


@query(f"""with {LOG} select conv_id, max(arrival) filter (outcome <> 'rejected') as last_touched, count(*) filter (outcome = 'replayed') as replays, count(*) filter (outcome = 'admitted') as events,
 'k-' || substr(sha256(conv_id || '|' || count(distinct turn)), 1, 40) as upsert_key from outcomes group by conv_id""")
def replayed_upsert_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay touches its conversation but adds no event."""
    o = C.outcomes(C.capture_log(spark, sf_dir))
    g = o.groupBy("conv_id").agg(F.max(F.when(F.col("outcome") != "rejected", F.col("arrival"))).alias("last_touched"), F.count_if(F.col("outcome") == "replayed").alias("replays"), F.count_if(F.col("outcome") == "admitted").alias("events"), F.countDistinct("turn").alias("turns"))
    return g.select("conv_id", "last_touched", "replays", "events", F.concat(F.lit("k-"), F.substring(F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turns").cast("string")), 256), 1, 40)).alias("upsert_key"))


@query(r"""select event_id, sha256(replace(props, ' ', '')) as document_sha256, cast(('0x' || substr(sha256(replace(props, ' ', '')), 1, 8)) as bigint) % 2000000000 + 1 as config_version from events""")
def config_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and version number of each document in canonical form."""
    own = table(spark, sf_dir, "events").select("event_id", R.canonical_json(F.col("props")).alias("document"))
    return own.select("event_id", F.sha2("document", 256).alias("document_sha256"), R.config_version(F.col("document")).alias("config_version"))


HOSTS = ["ththth.example.net", "m.ththth.example.net", "thther.example.org"]


@query(f"select page_id, starts_with(url, 'https://') and regexp_extract(url, '^https?://([^/?#:]+)', 1) in ({', '.join(map(repr, HOSTS))}) as allowed, regexp_extract(url, '^https?://([^/?#:]+)', 1) as host, coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), ''), '1') as place from pages")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    place = F.coalesce(F.nullif(F.regexp_extract("url", "[?&]page=([0-9]+)", 1), F.lit("")), F.lit("1"))
    return p.select("page_id", R.allowed_url(p["url"], HOSTS).alias("allowed"), F.try_parse_url("url", F.lit("HOST")).alias("host"), place.alias("place"))


@query(f"""select event_id, {_E} - {_E} % 300 as bucket, regexp_replace(event_type, '[^0-9a-f]', '0', 'g') || repeat('0', 64 - length(event_type)) as placeholder_digest,
 sha256('archive|' || lower(trim(cast(user_id as varchar)))) as actor from events""")
def event_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets, placeholder digests of 64 hexadecimal digits and pseudonymous actors."""
    e = table(spark, sf_dir, "events")
    digest = F.rpad(F.regexp_replace("event_type", "[^0-9a-f]", "0"), 64, "0")
    return e.select("event_id", bucket(epoch("ts")).alias("bucket"), digest.alias("placeholder_digest"), pseudonym(F.col("user_id").cast("string"), "archive").alias("actor"))
