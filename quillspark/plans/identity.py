"""Scalars, admission, identity and conversation state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import capture as C
from ..operators import identity as I
from ..sources.tables import epoch, table
from .registry import query
from .sql import EPOCH, LOG, RESOLVED

SALT = "archive"


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus in ('F', 'P') and o_totalprice >= 1000.0 and o_totalprice <= 200000.0 and o_orderdate < timestamp '1998-01-01' and o_orderpriority is not null")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    wanted = o["o_orderstatus"].isin("F", "P") & o["o_totalprice"].between(1000.0, 200000.0) & (o["o_orderdate"] < F.lit("1998-01-01").cast("timestamp_ntz")) & o["o_orderpriority"].isNotNull()
    return o.where(wanted).select("o_orderkey", "o_custkey", "o_totalprice")


@query(r"select conv_id, turn, sha256(text) as content_sha256, sha256(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')) as normalized_sha256 from conversations")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("content_sha256"), T.content_hash(F.col("text")).alias("normalized_sha256"))


def fingerprinted(log: DataFrame) -> DataFrame:
    """Captures with their fingerprint: at source_created_at, which base captures have (an hour a conversation, a minute a turn) and others lack."""
    seconds = F.when(F.col("rank") == 2, F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    print_ = T.fingerprint(F.col("conv_id"), F.col("role"), F.col("digest"), F.col("seq"), T.bucket(seconds))
    return C.hashed(log).withColumn("fingerprint", print_)


@query(f"""with {LOG} select key, arrival, sha256(conv_id || '|' || lower(role) || '|' || digest || '|' || cast(floor(seq / 5) as bigint) || '|' ||
  case when rank = 2 then (1704067200 + conv_id * 3600 + turn * 60) - (1704067200 + conv_id * 3600 + turn * 60) % 300 else 0 end) as fingerprint from log""")
def message_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(C.capture_log(spark, sf_dir)).select("key", "arrival", "fingerprint")


@query(f"select c_custkey, sha256('{SALT}|' || lower(trim(c_name))) as pseudonym, substr(sha256('{SALT}|' || lower(trim(c_mktsegment))), 1, 32) as workspace_hash from customer")
def pseudonymise_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.pseudonym(c["c_name"], SALT).alias("pseudonym"), F.substring(T.pseudonym(c["c_mktsegment"], SALT), 1, 32).alias("workspace_hash"))


@query("select conv_id, turn, cast(length(text) as bigint) as char_count, cast(greatest(1, length(text) // 4) as bigint) as token_estimate from conversations")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.length("text").cast("long").alias("char_count"), T.token_estimate(c["text"]).alias("token_estimate"))


@query(r"select doc_id, sha256(trim(substr(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), '[ \t]+', ' ', 'g'), 1, 1000000), E' \t\n\r')) as clean_sha256 from documents")
def clean_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(T.cleaned(d["text"]), 256).alias("clean_sha256"))


@query(r"""with p as (select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '[^A-Za-z0-9._-]', '_', 'g'), '\.{2,}', '.', 'g') as n, url from pages),
 q as (select page_id, url, regexp_replace(regexp_extract(n, '^(.*?)(\.[A-Za-z0-9]{1,10})?$', 1), '^[._-]+|[._-]+$', '', 'g') as stem, lower(regexp_extract(n, '(\.[A-Za-z0-9]{1,10})$', 1)) as ext from p)
 select page_id, case when coalesce(url, '') = '' then 'attachment.bin' else substr(case when stem = '' then 'file' else stem end, 1, 100) || ext end as filename from q""")
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.safe_filename(p["url"]).alias("filename"))


KIND = "case when lower(event_type) like '%delet%' or lower(event_type) like '%purge%' then 'deletion' when lower(event_type) like '%error%' then 'failure' when lower(event_type) like '%view%' or lower(event_type) like '%click%' then 'activity' else 'message' end"


@query(f"select event_id, {KIND} as kind, lower(event_type) like '%delet%' as is_deletion, {EPOCH.format('ts')} as event_seconds, json_extract_string(props, '$.k') as field from events")
def classify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.expr(KIND).alias("kind"), F.lower("event_type").contains("delet").alias("is_deletion"), epoch("ts").alias("event_seconds"), F.get_json_object("props", "$.k").alias("field"))


def _redaction_sql() -> str:
    out = "text"
    for pattern, mark in T.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern}', '{mark}', 'g')"
    return out


@query(f"select doc_id, sha256({_redaction_sql()}) as redacted_sha256, cast(length({_redaction_sql()}) as bigint) as n_chars from documents")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "documents").select("doc_id", T.redacted(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.sha2("clean", 256).alias("redacted_sha256"), F.length("clean").cast("long").alias("n_chars"))


@query(r"""select event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') as document_sha256 from events""")
def canonical_json_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order, no spaces; ASCII values need no escapes, so to_json is the canonical form."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.sha2(F.to_json(F.struct("event_id", "event_type", "user_id")), 256).alias("document_sha256"))


@query(f"with {LOG} select key, arrival, reject_reason from checked")
def validate_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.checked(C.capture_log(spark, sf_dir)).select("key", "arrival", "reject_reason")


@query(f"with {LOG} select key, arrival, conv_id, turn from admitted")
def idempotent_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.admitted(C.capture_log(spark, sf_dir)).select("key", "arrival", "conv_id", "turn")


@query(f"""with {LOG} select cast(count(*) as bigint) as captures, count(*) filter (outcome = 'admitted') as admitted, count(*) filter (outcome = 'replayed') as replayed,
 count(*) filter (outcome = 'rejected') as rejected, count(distinct conv_id) as conversations from outcomes""")
def batch_outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C.outcomes(C.capture_log(spark, sf_dir))
    tally = [F.count_if(F.col("outcome") == x).alias(x) for x in ("admitted", "replayed", "rejected")]
    return o.agg(F.count("*").alias("captures"), *tally, F.countDistinct("conv_id").alias("conversations"))


@query(f"with {LOG} select conv_id, role, digest, min(arrival) as first_arrival, count(*) as captures, arg_max(seq, arrival) as seq from log where rank between 1 and 5 group by all")
def identity_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.by_content(C.capture_log(spark, sf_dir).where("rank between 1 and 5"))


@query(f"{RESOLVED} select * exclude (current_digest, latest_complete) from messages")
def identity_three_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted = C.admitted(C.capture_log(spark, sf_dir)).drop("declared")
    seconds_free = C.hashed(admitted).withColumn("fingerprint", T.fingerprint(F.col("conv_id"), F.col("role"), F.col("digest"), F.col("seq"), F.lit(0)))
    return I.three_layer(admitted, seconds_free)


@query(f"""with {LOG} select conv_id, turn, version_number, digest, first_arrival, version_number > 1 and role = 'user' as is_edit, version_number > 1 and role = 'assistant' as is_regeneration,
 cast(length(text) as bigint) as char_count, cast(greatest(1, length(text) // 4) as bigint) as token_estimate from versions""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = I.versions(C.admitted(C.capture_log(spark, sf_dir)))
    later = F.col("version_number") > 1
    return v.select(
        "conv_id", "turn", "version_number", "digest", "first_arrival", (later & (F.col("role") == "user")).alias("is_edit"), (later & (F.col("role") == "assistant")).alias("is_regeneration"),
        F.length("text").cast("long").alias("char_count"), T.token_estimate(F.col("text")).alias("token_estimate"),
    )


@query(f"with {LOG} select conv_id, turn, role, max(version_number) as version_count, arg_max(digest, version_number) as current_digest, coalesce(max(case when completed then version_number end), 0) as latest_complete from versions group by all")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.current(I.versions(C.admitted(C.capture_log(spark, sf_dir))))


@query(f"""with {LOG} select conv_id, turn, version_number, case when first_status = 'partial' and completed then 'reconciled' else first_status end as version_status,
 case when bool_or(completed) over (partition by conv_id, turn) then 'complete' else 'partial' end as message_status,
 coalesce(case when first_status = 'partial' and not completed then max(case when completed then version_number end) over (partition by conv_id, turn) end, 0) as superseded_by from versions""")
def partial_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = I.versions(C.admitted(C.capture_log(spark, sf_dir)))
    message = Window.partitionBy("conv_id", "turn")
    partial = F.col("first_status") == "partial"
    return v.select(
        "conv_id", "turn", "version_number", F.when(partial & F.col("completed"), "reconciled").otherwise(F.col("first_status")).alias("version_status"),
        F.when(F.bool_or("completed").over(message), "complete").otherwise("partial").alias("message_status"),
        F.coalesce(F.when(partial & ~F.col("completed"), F.max(F.when(F.col("completed"), F.col("version_number"))).over(message)), F.lit(0)).alias("superseded_by"),
    )


@query(f"""with {LOG}, k as (select * from outcomes where outcome <> 'rejected')
 select conv_id, arg_max(substr(text, 1, 40), arrival) filter (role = 'user') as title, min(arrival) as first_captured, max(arrival) as last_captured, count(distinct turn) as message_count,
 cast(coalesce(sum(length(text)), 0) as bigint) as chars_seen from k group by conv_id""")
def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays touch a conversation, rejected captures don't."""
    k = C.outcomes(C.capture_log(spark, sf_dir)).where("outcome <> 'rejected'")
    user = F.when(F.col("role") == "user", F.col("arrival"))
    return k.groupBy("conv_id").agg(
        F.max_by(F.substring("text", 1, 40), user).alias("title"), F.min("arrival").alias("first_captured"), F.max("arrival").alias("last_captured"),
        F.countDistinct("turn").alias("message_count"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars_seen"),
    )


#: Completeness labels from least to most.
LATTICE = ("unknown", "visible_only", "partial", "probably_complete", "complete")
RANK = "case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3 when 'purchase' then 4 else 0 end"


@query(f"select user_id, list_extract(['unknown', 'visible_only', 'partial', 'probably_complete', 'complete'], max({RANK}) filter (event_type <> 'purchase' or value >= 10) + 1) as completeness, count(*) as events from events group by user_id")
def completeness_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rises: the highest rank reported, where the strongest one counts only if it is confirmed."""
    rank = F.max(F.expr(f"case when event_type <> 'purchase' or value >= 10 then {RANK} end"))
    labels = F.array(*map(F.lit, LATTICE))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(rank.alias("rank"), F.count("*").alias("events")).select("user_id", F.get(labels, F.col("rank")).alias("completeness"), "events")


@query("select user_id, string_agg(event_type, ',' order by f) as sources from (select user_id, event_type, min(event_id) as f from events group by all) group by user_id")
def capture_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in order of first use. At most one entry a kind meets in the list."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ",").alias("sources"))


@query("""select c_custkey, count(o_orderkey) as conversations, count(*) filter (o_orderstatus = 'F') as complete, round(coalesce(sum(o_totalprice), 0), 2) as total, max(o_orderdate) as last_captured
 from customer left join orders on o_custkey = c_custkey group by c_custkey order by last_captured desc nulls last, c_custkey limit 500""")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.sum("o_totalprice").alias("s"), F.max("o_orderdate").alias("last_captured"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    out = c.select("c_custkey", zero("n").alias("conversations"), zero("f").alias("complete"), F.round(zero("s"), 2).alias("total"), "last_captured")
    return out.orderBy(F.desc_nulls_last("last_captured"), "c_custkey").limit(500)


@query(f"with {LOG}, s as (select conv_id, max(arrival) filter (rank <= 2) as snapshot_at, max(arrival) as changed_at from admitted group by conv_id) select conv_id, coalesce(snapshot_at, -1) as snapshot_at, changed_at from s where snapshot_at is null or changed_at > snapshot_at")
def snapshot_dirty_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations changed since the snapshot taken after the base captures; each once, however many changes."""
    s = C.admitted(C.capture_log(spark, sf_dir)).groupBy("conv_id").agg(F.max(F.when(F.col("rank") <= 2, F.col("arrival"))).alias("snapshot_at"), F.max("arrival").alias("changed_at"))
    return s.where("snapshot_at is null or changed_at > snapshot_at").withColumn("snapshot_at", F.coalesce("snapshot_at", F.lit(-1)))
