"""Retention with batches and its cascade, pruning, conditional enqueueing, gates, checkpoints and default partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..sources.tables import epoch, table
from .operations import _E, _KEPT_SQL, AS_OF, JOBS, POLICIES, aged, jobs
from .registry import query

#: Rows of a soft and of a hard deletion's batch.
SOFT_BATCH, HARD_BATCH = 1000, 200
DAY = 86400


@query(f"""with {_KEPT_SQL}, n as (select *, row_number() over (partition by segment order by o_orderkey) - 1 as soft, row_number() over (partition by segment, gone order by o_orderkey) - 1 as hard from aged where expired)
 select segment, 'soft' as action, cast(soft // {SOFT_BATCH} as bigint) as batch, count(*) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key from n group by all
 union all select segment, 'hard', cast(hard // {HARD_BATCH} as bigint), count(*), min(o_orderkey), max(o_orderkey) from n where gone group by all""")
def retention_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches in which a policy's conversations go, by key, so that each is the same whenever it is tried again."""
    expired = aged(spark, sf_dir).where("expired")
    out = None
    for action, rows, size in (("soft", expired, SOFT_BATCH), ("hard", expired.where("gone"), HARD_BATCH)):
        batch = numbered(rows, "segment", "o_orderkey").withColumn("batch", F.floor(F.col("number") / size).cast("long"))
        own = batch.groupBy("segment", F.lit(action).alias("action"), "batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""with {_KEPT_SQL} select segment, count(*) as messages, count(*) filter (gone) as deleted, count(*) filter (not gone and expired and l_partkey % 97 <> 0) as hidden,
 count(*) filter (not gone and expired and l_partkey % 97 = 0) as held, count(distinct o_orderkey) filter (gone) as conversations_deleted from aged join lineitem on l_orderkey = o_orderkey group by segment""")
def retention_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for messages: a deletion takes all of a conversation's, hiding it leaves those with a hold of their own. Lines are summed up by conversation before they meet it."""
    held = F.col("l_partkey") % 97 == 0
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.count_if(held).alias("on_hold"))
    rows = aged(spark, sf_dir).join(own, "o_orderkey")
    hidden = F.col("expired") & ~F.col("gone")
    total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0))
    return rows.groupBy("segment").agg(
        F.sum("lines").alias("messages"), total(F.col("gone"), F.col("lines")).alias("deleted"), total(hidden, F.col("lines") - F.col("on_hold")).alias("hidden"), total(hidden, F.col("on_hold")).alias("held"),
        F.count_if("gone").alias("conversations_deleted"),
    )


_DEFAULT = ("default", 365, 30, "soft_delete")
_SOME = POLICIES[:3]


@query(f"""with p(segment, retain_days, grace_days, action) as (values {', '.join(map(str, _SOME))}) select c_mktsegment as segment, case when retain_days is null then 'default' else 'own' end as policy, coalesce(retain_days, 365) as retain_days,
 coalesce(grace_days, 30) as grace_days, coalesce(action, 'soft_delete') as action, retain_days is null as created from (select distinct c_mktsegment from customer) left join p on segment = c_mktsegment""")
def default_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each organisation's policy, or the default one where it has none."""
    own = F.broadcast(spark.createDataFrame(_SOME, "segment string, retain_days int, grace_days int, action string"))
    found = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct().join(own, "segment", "left")
    name, retain, grace, action = _DEFAULT
    none = F.col("retain_days").isNull()
    return found.select("segment", F.when(none, name).otherwise("own").alias("policy"), F.coalesce("retain_days", F.lit(retain)).alias("retain_days"), F.coalesce("grace_days", F.lit(grace)).alias("grace_days"), F.coalesce("action", F.lit(action)).alias("action"), none.alias("created"))


#: Days that keys, finished jobs and pending attachments are kept; keys go by four times the age of a client's queue.
QUEUE_AGE, JOB_DAYS = 7, 14
KEY_DAYS = max(4 * QUEUE_AGE, 30)
NOW = AS_OF + 20 * DAY


@query(f"""with {JOBS} select kind, count(*) as n, count(*) filter (created < {NOW - KEY_DAYS * DAY}) as keys_pruned, count(*) filter (status = 'succeeded' and created < {NOW - JOB_DAYS * DAY}) as jobs_pruned from jobs group by kind""")
def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What housekeeping drops, both horizons in one scan."""
    old = lambda days: F.col("created") < NOW - days * DAY
    return jobs(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(old(KEY_DAYS)).alias("keys_pruned"), F.count_if(old(JOB_DAYS) & (F.col("status") == "succeeded")).alias("jobs_pruned"))


@query(f"""with {_KEPT_SQL}, {JOBS} select (select count(*) from aged where expired) as soft_deleted, (select count(*) from aged where gone) as hard_deleted, (select count(*) from jobs where created < {NOW - KEY_DAYS * DAY}) as keys_pruned,
 (select count(*) from jobs where status = 'pending' and created < {NOW - DAY}) as attachments_expired""")
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fold over all policies and housekeeping; each part is one row before they meet."""
    gone = aged(spark, sf_dir).agg(F.count_if("expired").alias("soft_deleted"), F.count_if("gone").alias("hard_deleted"))
    kept = jobs(spark, sf_dir).agg(F.count_if(F.col("created") < NOW - KEY_DAYS * DAY).alias("keys_pruned"), F.count_if((F.col("status") == "pending") & (F.col("created") < NOW - DAY)).alias("attachments_expired"))
    return gone.crossJoin(kept)  # one row each


@query(f"""with {JOBS}, live as (select distinct user_id || ':' || kind as k from jobs where status in ('pending', 'running')), req as (select job_id, case when job_id % 5 = 0 then null else (user_id + 7) || ':' || kind end as k from jobs)
 select min(job_id) as job_id, k as dedupe_key from req where k is not null and k not in (select k from live) group by k union all select job_id, '' from req where k is null""")
def enqueue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that become jobs: without a key always, else the first of a key that no pending or running job has."""
    known = jobs(spark, sf_dir)
    key = lambda user: F.concat(user.cast("string"), F.lit(":"), "kind")
    live = known.where(F.col("status").isin("pending", "running")).select(key(F.col("user_id")).alias("dedupe_key")).distinct()
    requests = known.select("job_id", F.when(F.col("job_id") % 5 != 0, key(F.col("user_id") + 7)).alias("dedupe_key"))
    first = requests.where(F.col("dedupe_key").isNotNull()).groupBy("dedupe_key").agg(F.min("job_id").alias("job_id")).join(live, "dedupe_key", "left_anti")
    return first.select("job_id", "dedupe_key").unionByName(requests.where(F.col("dedupe_key").isNull()).select("job_id", F.lit("").alias("dedupe_key")))


#: Bytes that an item of a client's queue may have.
MOST_BYTES = 300


@query(f"""select user_id || '-' || event_type as idempotency_key, min(event_id) as event_id, cast(arg_min(size, event_id) as bigint) as byte_size from (select *, strlen(repeat(props, cast(event_id % 50 + 1 as int))) as size from events) where size <= {MOST_BYTES} group by 1""")
def client_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a client's queue takes: none too large, and the first of each key."""
    e = table(spark, sf_dir, "events").withColumn("size", F.octet_length(F.expr("repeat(props, cast(event_id % 50 + 1 as int))")).cast("long")).where(F.col("size") <= MOST_BYTES)
    return e.groupBy(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("idempotency_key")).agg(F.min("event_id").alias("event_id"), F.min_by("size", "event_id").alias("byte_size"))


#: Kinds of files that are taken, with their extensions.
MIME_TYPES = {
    "image/png": [".png"], "image/jpeg": [".jpg", ".jpeg"], "image/webp": [".webp"], "image/gif": [".gif"], "application/pdf": [".pdf"], "text/plain": [".txt", ".log", ".md"], "text/csv": [".csv"], "text/markdown": [".md"],
    "application/json": [".json"], "application/vnd.openxmlformats-officedocument.wordprocessingml.document": [".docx"], "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": [".xlsx"],
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": [".pptx"],
}
FILE_BYTES = 20_000
_MIME = "case lang when 'en' then 'TEXT/plain; charset=utf-8' when 'de' then 'text/markdown' when 'fr' then 'application/x-sh' else '' end"


@query(f"""with f as (select doc_id, doc_id % 50 as conversation, lower(split_part(coalesce(nullif({_MIME}, ''), 'application/octet-stream'), ';', 1)) as mime, strlen("text") as byte_size, sha256("text") as digest, source || '.txt' as filename from documents where "text" is not null),
 ok as (select * from f where byte_size > 0 and byte_size <= {FILE_BYTES} and mime in ({', '.join(map(repr, MIME_TYPES))}))
 select min(doc_id) as doc_id, conversation, digest, filename, arg_min(mime, doc_id) as mime, cast(max(byte_size) as bigint) as byte_size from ok group by conversation, digest, filename""")
def captured_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a client captures: not empty, not too large, of a known kind, and once for each conversation, content and name."""
    kind = F.lower(F.split_part(F.expr(f"coalesce(nullif({_MIME}, ''), 'application/octet-stream')"), F.lit(";"), F.lit(1)))
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("conversation"), kind.alias("mime"), F.octet_length("text").cast("long").alias("byte_size"), "text", F.concat("source", F.lit(".txt")).alias("filename"))
    ok = d.where(F.col("byte_size").between(1, FILE_BYTES) & F.col("mime").isin(list(MIME_TYPES)))
    return ok.groupBy("conversation", F.sha2("text", 256).alias("digest"), "filename").agg(F.min("doc_id").alias("doc_id"), F.min_by("mime", "doc_id").alias("mime"), F.max("byte_size").alias("byte_size"))


@query("select string_agg(x, ',' order by x) as extensions from (select distinct x from (values " + ", ".join(f"('{x}')" for own in MIME_TYPES.values() for x in own) + ") v(x))")
def allowed_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[x for kind, own in MIME_TYPES.items() for x in (F.lit(kind), F.array(*map(F.lit, own)))])
    return spark.range(1).select(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.map_values(kinds)))), ",").alias("extensions"))


#: Kinds of exports with what each needs: (kind, training enabled, role).
REQUESTS = [("curated_training_jsonl", False, "admin"), ("curated_training_jsonl", True, "admin"), ("compliance_extract", False, "admin"), ("legal_hold_bundle", False, "admin"), ("legal_hold_bundle", False, "compliance_admin")]
_GATE = "case when kind = 'curated_training_jsonl' and not enabled then 'training_export_disabled' when kind = 'legal_hold_bundle' and role <> 'compliance_admin' then 'role_required' else 'allowed' end"
LISTED = 100


@query(f"""with r(kind, enabled, role) as (values {', '.join(map(str, REQUESTS))}), p as (select list(part order by part) as parts from (select distinct 'part-' || lpad(cast(o_orderkey // 5 as varchar), 8, '0') as part from orders))
 select kind, enabled, role, {_GATE} as outcome, case when {_GATE} = 'allowed' then len(parts[1:{LISTED}]) else 0 end as listed, case when {_GATE} = 'allowed' then parts[{LISTED}] else '' end as last_part from r cross join p""")
def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests pass, and the first hundred parts that those are shown: a top-k, so that only those meet."""
    asked = spark.createDataFrame(REQUESTS, "kind string, enabled boolean, role string").withColumn("outcome", F.expr(_GATE))
    part = F.concat(F.lit("part-"), F.lpad(F.floor(F.col("o_orderkey") / 5).cast("string"), 8, "0"))
    parts = table(spark, sf_dir, "orders").select(part.alias("part")).distinct().orderBy("part").limit(LISTED).agg(F.count("*").alias("many"), F.max("part").alias("last"))
    ok = F.col("outcome") == "allowed"
    return asked.crossJoin(parts).select("kind", "enabled", "role", "outcome", F.when(ok, F.col("many")).otherwise(F.lit(0)).alias("listed"), F.when(ok, F.col("last")).otherwise(F.lit("")).alias("last_part"))  # one row of parts


STREAMS = ["signup", "purchase", "error", "view", "click", "default", "reload"]


@query(f"""with s(stream) as (values {', '.join(f"('{x}')" for x in STREAMS)}), m as (select event_type, max({_E}) as last from events group by event_type)
 select stream, coalesce(last, {AS_OF - DAY}) as window_start, last is null as created from s left join m on event_type = stream""")
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each stream's pull goes on: behind what it has, or a day ago."""
    asked = spark.createDataFrame([(x,) for x in STREAMS], "stream string")
    last = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stream")).agg(F.max(epoch("ts")).alias("last"))
    return asked.join(last, "stream", "left").select("stream", F.coalesce("last", F.lit(AS_OF - DAY)).alias("window_start"), F.col("last").isNull().alias("created"))


SCROLLS, STABLE, MESSAGES = 200, 3, 5


@query(f"""with s as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as step from events),
 n as (select *, row_number() over (partition by user_id, event_type order by event_id) = 1 as new from s where step <= {SCROLLS}),
 c as (select *, sum(new::int) over w as messages, step - max(case when new then step end) over w as still from n window w as (partition by user_id order by event_id)),
 d as (select *, case when messages >= {MESSAGES} then 'message_limit' when still >= {STABLE} then 'stalled' when step >= {SCROLLS} then 'scroll_limit' end as reason from c)
 select user_id, min(step) as steps, arg_min(reason, step) as reason, cast(arg_min(messages, step) as bigint) as messages from d where reason is not null group by user_id""")
def backfill_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step at which a backfill ends: enough messages, none new for some steps, or too many steps. A user's later events are cut
    off by their rank, which Spark limits before it shuffles."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    s = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.row_number().over(by).alias("step")).where(F.col("step") <= SCROLLS)
    n = s.withColumn("new", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) == 1)
    c = n.withColumns({"messages": F.sum(F.col("new").cast("long")).over(by), "still": F.col("step") - F.max(F.when(F.col("new"), F.col("step"))).over(by)})
    reason = F.when(F.col("messages") >= MESSAGES, "message_limit").when(F.col("still") >= STABLE, "stalled").when(F.col("step") >= SCROLLS, "scroll_limit")
    d = c.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return d.groupBy("user_id").agg(F.min("step").cast("long").alias("steps"), F.min_by("reason", "step").alias("reason"), F.min_by("messages", "step").alias("messages"))


@query("""select 'orders' as table_name, count(*) as n, count(*) filter (o_orderdate is null or o_orderdate < timestamp '1993-01-01' or o_orderdate >= timestamp '1998-01-01') as default_rows from orders
 union all select 'lineitem', count(*), count(*) filter (l_shipdate is null or l_shipdate < timestamp '1993-01-01' or l_shipdate >= timestamp '1998-01-01') from lineitem""")
def default_partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no ensured month takes."""

    def counted(name: str, column: str) -> DataFrame:
        outside = F.expr(f"{column} is null or {column} < timestamp_ntz'1993-01-01' or {column} >= timestamp_ntz'1998-01-01'")
        return table(spark, sf_dir, name).agg(F.count("*").alias("n"), F.count_if(outside).alias("default_rows")).select(F.lit(name).alias("table_name"), "n", "default_rows")

    return counted("orders", "o_orderdate").unionByName(counted("lineitem", "l_shipdate"))


@query(f"""select user_id, count(*) as n, cast(sum(value) as double) as total from events where {{}} group by user_id""".format(f"event_type in ('click', 'view') and {_E} >= {AS_OF - 20 * DAY}"))
def filtered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing under those predicates that a request has."""
    return listing(table(spark, sf_dir, "events"), kinds=["click", "view"], since=AS_OF - 20 * DAY).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def listing(events: DataFrame, kinds: list[str] | None = None, since: int | None = None, until: int | None = None, user: int | None = None) -> DataFrame:
    """events under the predicates given; one that isn't given leaves no trace in the plan."""
    for given, condition in ((kinds, lambda: F.col("event_type").isin(kinds)), (since, lambda: epoch("ts") >= since), (until, lambda: epoch("ts") <= until), (user, lambda: F.col("user_id") == user)):
        if given is not None:
            events = events.where(condition())
    return events
