"""Clients and what they are told: statuses, revoked devices, sync status, and a log of attempts at batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import devices as D
from ..sources.tables import event_stream, table
from ..streaming import attempts as A
from ..streaming.events import scratch
from .operations import JOBS, jobs
from .registry import query

DEFAULTS = {"signed_in": "false", "workspace_label": None, "queue_size": "0", "last_error": None, "config_version": "none"}
#: What an event patches: (field, condition, value), in SQL that both engines read.
_PATCH = [
    ("signed_in", "event_id % 2 = 0", "case when event_id % 3 = 0 then 'false' else 'true' end"), ("workspace_label", "event_id % 5 = 1", "case when event_id % 4 = 0 then null else concat('w', event_id) end"), ("queue_size", "event_id % 3 <> 1", "cast(event_id % 90 as {text})"),
    ("last_error", "event_type = 'error'", "concat('e', event_id)"), ("unknown", "event_id % 2 = 1", "'x'"),
]


@query(
    "select user_id as device, "
    + ", ".join(
        f"coalesce(case when bool_or({c}) then arg_max(coalesce({v.format(text='varchar')}, '(null)'), event_id) filter ({c}) else '{DEFAULTS[f] or '(null)'}' end, '(null)') as {f}" for f, c, v in _PATCH if f in DEFAULTS
    )
    + ", 'none' as config_version from events group by user_id"
)
def device_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device's status after all patches, which have some fields each; (null) stands for no value."""
    given = F.filter(F.array(*(F.when(F.expr(c), F.struct(F.lit(f).alias("key"), F.expr(v.format(text="string")).alias("value"))) for f, c, v in _PATCH)), lambda x: x.isNotNull())
    patches = table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("at"), F.map_from_entries(given).alias("fields"))
    s = D.patched(patches, DEFAULTS)
    return s.select("device", *(F.coalesce(f, F.lit("(null)")).alias(f) for f in DEFAULTS))


_REQUESTS = "select o_orderkey as request, o_custkey + 40 * cast(o_orderkey % 17 = 0 as int) as device, case when o_orderkey % 5 = 0 then (o_orderkey // 5) % 25 else c_nationkey end as organization, case o_orderkey % 3 when 0 then '' when 1 then 'lost ' || o_orderkey end as reason from orders join customer on o_custkey = c_custkey where o_orderkey % 7 < 3"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of some keys as requests: most from the customer's own nation, some from another, some of a device next door."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 7 < 3).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    organization = F.when(key % 5 == 0, F.expr("o_orderkey div 5") % 25).otherwise(F.col("c_nationkey"))
    return o.select(key.alias("request"), (F.col("o_custkey") + 40 * (key % 17 == 0).cast("int")).alias("device"), organization.alias("organization"), key.alias("at"), F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("lost "), key.cast("string"))).alias("reason"))


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("device"), F.col("c_nationkey").alias("organization"), F.sha2("c_name", 256).alias("refresh_token_hash"), F.col("c_name").alias("session_id"), F.lit(None).cast("long").alias("revoked_at"), F.lit(None).cast("string").alias("revoked_reason"))


@query(f"with r as ({_REQUESTS}) select request, device, case when c_custkey is not null then 'revoked' else 'not_found' end as status from r left join customer on device = c_custkey and organization = c_nationkey")
def device_revocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request for a revocation is answered."""
    return D.revocations(_devices(spark, sf_dir), _requests(spark, sf_dir))


@query(f"""with r as ({_REQUESTS}), l as (select device, organization, max(request) as last, arg_max(coalesce(nullif(reason, ''), '{D.REASON}'), request) as reason from r group by all)
 select c_custkey as device, l.last is null as active, coalesce(l.last, -1) as revoked_at, coalesce(l.reason, '') as revoked_reason, case when l.last is null then sha256(c_name) else '' end as refresh_token_hash from customer left join l on c_custkey = device and c_nationkey = organization""")
def revoked_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices after all requests of their own organization."""
    d = D.revoked(_devices(spark, sf_dir), _requests(spark, sf_dir))
    return d.select("device", F.col("session_id").isNotNull().alias("active"), F.coalesce("revoked_at", F.lit(-1)).alias("revoked_at"), F.coalesce("revoked_reason", F.lit("")).alias("revoked_reason"), F.coalesce("refresh_token_hash", F.lit("")).alias("refresh_token_hash"))


#: Fixed value: pending jobs from which on clients are asked to wait.
BACKPRESSURE = 50_000


@query(f"""with {JOBS}, q as (select count(*) filter (status = 'pending') as depth from jobs), m as (select l_orderkey, count(*) as n from lineitem group by l_orderkey), o as (select o_custkey, count(*) as c, cast(sum(coalesce(n, 0)) as bigint) as m, max(o_orderkey) as last from orders left join m on o_orderkey = l_orderkey group by o_custkey)
 select c_custkey as device, coalesce(c, 0) as conversations, coalesce(o.m, 0) as messages, coalesce(last, -1) as last_sync, depth as queue_depth, depth >= {BACKPRESSURE} as backpressure, c_acctbal >= 0 as capture_enabled from customer left join o on c_custkey = o_custkey cross join q""")
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each client is told: its own counts, and the queue's depth, which is one row for all."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.groupBy("o_custkey").agg(F.count("*").alias("c"), F.sum(F.coalesce("n", F.lit(0))).alias("m"), F.max("o_orderkey").alias("last"))
    depth = jobs(spark, sf_dir).agg(F.count_if(F.col("status") == "pending").alias("queue_depth"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").crossJoin(depth)
    zero = lambda x: F.coalesce(x, F.lit(0))
    return c.select(F.col("c_custkey").alias("device"), zero("c").alias("conversations"), zero("m").alias("messages"), F.coalesce("last", F.lit(-1)).alias("last_sync"), "queue_depth", (F.col("queue_depth") >= BACKPRESSURE).alias("backpressure"), (F.col("c_acctbal") >= 0).alias("capture_enabled"))


#: Batches of a replay that fail, how often and with what.
_FAILS = {0: [ValueError], 2: [OSError, KeyError]}
_ATTEMPTS = [(b, k + 1, *(("failed", own[k].__name__) if k < len(own) else ("succeeded", ""))) for b in range(3) for own in [_FAILS.get(b, [])] for k in range(len(own) + 1)]


@query(f"select cast(b as bigint) as batch, cast(k as int) as attempt_number, o as outcome, e as error_type, (select count(*) from events) as events, cast(0 as bigint) as failures, true as healthy from (values {', '.join(map(repr, _ATTEMPTS))}) as t(b, k, o, e)")
def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts at three batches of events, two of which fail after they have written; with all events that the successes counted."""
    folder = scratch(spark)
    events = table(spark, sf_dir, "events")
    events.repartition(3, "event_id").write.parquet(f"{folder}/events")
    left = {b: list(own) for b, own in _FAILS.items()}

    def work(batch: DataFrame, number: int) -> int:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/b-{number}")
        if left.get(number):
            raise left[number].pop(0)(f"batch {number}")
        return spark.read.schema(events.schema).parquet(f"{folder}/rows/b-{number}").count()

    tried = A.logged(work, f"{folder}/log", "replay")
    A.persevering(lambda: event_stream(spark, f"{folder}/events", events.schema, 1).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/check").foreachBatch(tried))
    log = A.attempts(spark, f"{folder}/log")
    total = log.groupBy("query").agg(F.sum("result").alias("events"))
    return log.join(total, "query").join(A.health(log), "query").select("batch", "attempt_number", "outcome", F.coalesce("error_type", F.lit("")).alias("error_type"), "events", "failures", "healthy")
