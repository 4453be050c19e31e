"""Queues, health, retention, holds and other operations over events, orders and customers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import limits as L
from ..sources.tables import epoch, instant, table
from .registry import query
from .sql import EPOCH

#: Jobs that events stand for: status by type, priority by user, attempts by value.
STATUS = "case event_type when 'signup' then 'pending' when 'view' then 'succeeded' when 'click' then 'running' when 'error' then 'failed' else 'dead' end"
AS_OF = 1706572800  # 2024-01-30 UTC
_E = EPOCH.format("ts")
JOBS = f"jobs as (select event_id as job_id, {STATUS} as status, event_type as kind, cast(user_id % 5 as bigint) as priority, cast(event_id % 15 as bigint) as attempts, {_E} as created, {_E} + (event_id % 7) * 60 as run_after, case when event_id % 3 = 0 then -1 else {_E} + 30 end as locked_at, user_id from events)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lock time of -1 stands for none."""
    e = table(spark, sf_dir, "events").withColumn("created", epoch("ts"))
    return e.select(
        F.col("event_id").alias("job_id"), F.expr(STATUS).alias("status"), F.col("event_type").alias("kind"), (F.col("user_id") % 5).alias("priority"), (F.col("event_id") % 15).alias("attempts"), "created",
        (F.col("created") + (F.col("event_id") % 7) * 60).alias("run_after"), F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("created") + 30).cast("long").alias("locked_at"), "user_id",
    )


@query(f"with {JOBS} select count(*) as jobs, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'running') as running, count(*) filter (status in ('failed', 'dead')) as broken, coalesce({AS_OF} - min(created) filter (status = 'pending'), 0) as oldest_pending_seconds from jobs")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts in one scan."""
    is_ = lambda *x: F.col("status").isin(*x)
    oldest = F.coalesce(F.lit(AS_OF) - F.min(F.when(is_("pending"), F.col("created"))), F.lit(0))
    return jobs(spark, sf_dir).agg(F.count("*").alias("jobs"), F.count_if(is_("pending")).alias("pending"), F.count_if(is_("running")).alias("running"), F.count_if(is_("failed", "dead")).alias("broken"), oldest.alias("oldest_pending_seconds"))


@query(f"with {JOBS} select status, kind, count(*) as n, min(created) as oldest from jobs group by all order by n desc, status, kind")
def queue_by_status_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("status", "kind").agg(F.count("*").alias("n"), F.min("created").alias("oldest")).orderBy(F.desc("n"), "status", "kind")


@query(f"with {JOBS} select job_id, priority, run_after from jobs where status = 'pending' and run_after <= {AS_OF} order by priority, run_after, created, job_id limit 20")
def claimable_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = jobs(spark, sf_dir).where((F.col("status") == "pending") & (F.col("run_after") <= AS_OF))
    return due.orderBy("priority", "run_after", "created", "job_id").limit(20).select("job_id", "priority", "run_after")


@query(f"with {JOBS} select job_id, case when attempts >= 12 then 'dead' else 'pending' end as next_status from jobs where status = 'running' and (locked_at = -1 or locked_at < {AS_OF} - 300)")
def stale_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = (F.col("status") == "running") & ((F.col("locked_at") == -1) | (F.col("locked_at") < AS_OF - 300))
    return jobs(spark, sf_dir).where(stale).select("job_id", F.when(F.col("attempts") >= 12, "dead").otherwise("pending").alias("next_status"))


@query(f"with {JOBS} select job_id, case when status = 'dead' then 'dead' when attempts >= 12 then 'failed' else 'retry' end as transition, cast(least(5 * pow(2, least(attempts, 12)), 3600) as bigint) as ceiling_seconds, cast(least(2000 * pow(2, least(attempts, 12)), 900000) as bigint) as client_ceiling_ms from jobs where status in ('failed', 'dead')")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ceilings only: the jitter below them is random by intent."""
    power = lambda a, most: F.least(a * F.pow(F.lit(2), F.least(F.col("attempts"), F.lit(12))), F.lit(most)).cast("long")
    transition = F.when(F.col("status") == "dead", "dead").when(F.col("attempts") >= 12, "failed").otherwise("retry")
    return jobs(spark, sf_dir).where(F.col("status").isin("failed", "dead")).select("job_id", transition.alias("transition"), power(5, 3600).alias("ceiling_seconds"), power(2000, 900000).alias("client_ceiling_ms"))


@query(f"select {_E} - {_E} % 60 as minute, count(*) as n from events where {_E} > {AS_OF} - 86400 group by 1 order by n desc, minute limit 20")
def ingest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(epoch("ts").alias("at")).where(F.col("at") > AS_OF - 86400)
    return e.groupBy((F.col("at") - F.col("at") % 60).alias("minute")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "minute").limit(20)


@query(f"""with {JOBS}, q as (select count(*) filter (status = 'pending') as pending, count(*) filter (status = 'dead') as dead, {AS_OF} - max(created) as lag_seconds from jobs),
 c as (select count(*) as n from conversations), d as (select count(*) as n from documents), u as (select count(*) as n from customer)
 select pending, dead, lag_seconds, c.n as turns, d.n as documents, u.n as users,
  concat_ws(',', case when pending >= 100 then 'backlog' end, case when dead > 0 then 'dead_jobs' end, case when lag_seconds > 3600 then 'lagging' end) as warnings from q, c, d, u""")
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of one row each, side by side."""
    q = jobs(spark, sf_dir).agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "dead").alias("dead"), (F.lit(AS_OF) - F.max("created")).alias("lag_seconds"))
    out = q
    for name, alias in (("conversations", "turns"), ("documents", "documents"), ("customer", "users")):
        out = out.crossJoin(table(spark, sf_dir, name).agg(F.count("*").alias(alias)))
    warn = F.concat_ws(",", F.when(F.col("pending") >= 100, "backlog"), F.when(F.col("dead") > 0, "dead_jobs"), F.when(F.col("lag_seconds") > 3600, "lagging"))
    return out.select("pending", "dead", "lag_seconds", "turns", "documents", "users", warn.alias("warnings"))


@query(f"""with a as (select event_id, user_id, {_E} as t, cast(floor(value) as bigint) as size from events),
 w as (select *, row_number() over (partition by user_id order by t desc, event_id desc) as place from a where t >= {AS_OF} - 7 * 86400),
 s as (select *, sum(size) over (partition by user_id order by t desc, event_id desc rows unbounded preceding) as bytes from w where place <= 50)
 select user_id, event_id from s where bytes <= 2000""")
def queue_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays in each client's bounded queue: young enough, among the newest 50, and the newest whose sizes fit."""
    a = table(spark, sf_dir, "events").select("event_id", "user_id", epoch("ts").alias("at"), F.floor("value").alias("size")).where(F.col("at") >= AS_OF - 7 * 86400)
    newest = Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("event_id"))
    kept = a.withColumn("place", F.row_number().over(newest)).where("place <= 50")
    return kept.withColumn("bytes", F.sum("size").over(newest.rowsBetween(Window.unboundedPreceding, 0))).where("bytes <= 2000").select("user_id", "event_id")


@query(f"with a as (select event_id, user_id, {_E} as t from events) select event_id, user_id, count(*) over (partition by user_id order by t range between 3600 preceding and current row) as hits_upper_bound from a")
def rate_limit_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the window before each, as if none had been denied."""
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-3600, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", epoch("ts").alias("at")).withColumn("hits_upper_bound", F.count("*").over(w)).drop("at")


class _Limiter:
    """Admits while fewer than `most` admitted hits lie in the window before, both ends included; denied hits don't count."""

    def __init__(self, window: int = 86400, most: int = 2):
        self.window, self.admitted = window, deque(maxlen=most)  # the last admitted times are all that matters

    def allows(self, at: int | None) -> bool:
        if at is None:
            self.admitted.clear()
            return True
        ok = len(self.admitted) < self.admitted.maxlen or self.admitted[0] < at - self.window
        if ok:
            self.admitted.append(at)
        return ok


def _limit(rows: pd.DataFrame, window: int = 86400, most: int = 2) -> pd.DataFrame:
    """The hits of one user in order, with whether each is admitted."""
    rows = rows.sort_values(["at", "event_id"])
    limiter = _Limiter(window, most)
    return pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "allowed": [limiter.allows(at) for at in rows["at"]]})


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (user_id, at, event_id) in that order, a batch at a time; one user's limiter is all that is held."""
    user, limiter = None, _Limiter()
    for b in batches:
        allowed = []
        for who, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if who != user:
                user, limiter = who, _Limiter()
            allowed.append(limiter.allows(at))
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(allowed, pa.bool_())], ["event_id", "user_id", "allowed"])


@query()
def rate_limit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depends on its own earlier decisions, so each user's hits are folded in order as Spark's sort gives them."""
    a = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), epoch("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"))
    ordered = a.repartition("user_id").sortWithinPartitions("user_id", F.col("at").asc_nulls_last(), "event_id")
    return ordered.mapInArrow(_decisions, "event_id long, user_id long, allowed boolean")


#: Four limiters with windows that fit the events' distances: two requests a day, one an hour.
LIMITS = L.scopes(per_minute=2, burst=1, window=86400 * L.SECOND, short=3600 * L.SECOND)
_LIMITS = ", ".join(f"({k}, '{s.name}', {s.window}, {s.limit})" for k, s in enumerate(LIMITS))


@query(f"""with recursive l(scope, name, span, most) as (values {_LIMITS}), h as materialized (select event_id, epoch_us(ts) as now, scope, span, most, case scope when 2 then event_id % 211 when 3 then user_id % 25 else user_id end as key from events, l),
 n as materialized (select *, row_number() over (partition by scope, key order by now, event_id) as place from h),
 r as (select scope, key, place, event_id, [now] as hits, true as allowed, most - 1 as remaining, 0::bigint as retry_after from n where place = 1
  union all select n.scope, n.key, n.place, n.event_id, case when len(o.old) < most then list_append(o.old, now) else o.old end, len(o.old) < most, case when len(o.old) < most then most - 1 - len(o.old) else 0 end,
   case when len(o.old) < most then 0 else greatest(1, (span - (now - o.old[1])) // 1000000 + 1) end
   from r join n on n.scope = r.scope and n.key = r.key and n.place = r.place + 1, lateral (select list_filter(r.hits, lambda x: x >= n.now - n.span) as old) o)
 select event_id as request, arg_min(allowed, k) as allowed, arg_min(remaining, k)::bigint as remaining, arg_min(retry_after, k)::bigint as retry_after, arg_min(name, k) as scope, arg_min(most, k)::bigint as "limit"
 from (select r.*, name, most, row(allowed, case when allowed then remaining else -retry_after end, r.scope) as k from r join l using (scope)) group by event_id""")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strictest of four limiters' answers to each event as a request."""
    text = lambda c: c.cast("string")
    hits = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("request"), F.unix_micros(instant("ts")).alias("at"), F.lit(1).alias("cost"), text(F.col("user_id")).alias("user"), text(F.col("event_id") % 211).alias("device"), text(F.col("user_id") % 25).alias("address")
    )
    return L.decisions(hits, LIMITS)


_IDLE, _HELD = 2 * 86400 * L.SECOND, 40


@query(f"""with k as (select key, max(epoch_us(ts)) as last from (select 'u:' || user_id as key, ts from events union all select 'd:' || event_id % 211, ts from events) group by key),
 l as (select *, row_number() over (order by last, key) as place, count(*) over () as n from k where last >= {AS_OF * L.SECOND} - {_IDLE}) select key, last from l where n <= {_HELD} or place > n // 2""")
def limiter_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keys a limiter still holds: of users and devices seen in the last days the warmer half, as they are too many."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(instant("ts")).alias("at"))
    keys = F.array(F.concat(F.lit("u:"), F.col("user_id").cast("string")), F.concat(F.lit("d:"), (F.col("event_id") % 211).cast("string")))
    return L.pruned(e.select(F.explode(keys).alias("key"), "at").groupBy("key").agg(F.max("at").alias("last")), AS_OF * L.SECOND, _IDLE, _HELD)


@query("select c_custkey, c_name, o_orderkey, o_orderdate from customer join orders on o_custkey = c_custkey")
def subject_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer")
    return users.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_orderdate")


# Orders stand for conversations under retention; a market segment is a policy: days to keep, days of grace, action.
POLICIES = [("AUTOMOBILE", 2000, 100, "hard_delete"), ("BUILDING", 2400, 200, "hard_delete"), ("FURNITURE", 1500, 50, "soft_delete"), ("HOUSEHOLD", 3000, 400, "soft_delete"), ("MACHINERY", 1000, 30, "hard_delete")]
_POLICY_SQL = "policy(segment, retain_days, grace_days, action) as (values " + ", ".join(map(str, POLICIES)) + ")"
TODAY = "1999-01-01"
_KEPT_SQL = f"""{_POLICY_SQL}, c as (select o_orderkey, o_orderdate, c_mktsegment as segment, o_orderkey % 50 = 0 as held from orders join customer on c_custkey = o_custkey),
 aged as (select c.*, retain_days, grace_days, action, o_orderdate < timestamp '{TODAY}' - to_days(retain_days) and not held as expired,
   o_orderdate < timestamp '{TODAY}' - to_days(retain_days + grace_days) and not held and action = 'hard_delete' as gone from c join policy using (segment))"""


def aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their policy (a handful of rows, so broadcast), held or not, expired, and past grace."""
    policy = F.broadcast(spark.createDataFrame(POLICIES, "segment string, retain_days int, grace_days int, action string"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    before = lambda days: F.col("o_orderdate") < F.expr(f"timestamp_ntz'{TODAY}' - make_dt_interval({days})")
    held = F.col("o_orderkey") % 50 == 0
    rows = o.join(c, "o_custkey").join(policy, "segment")
    return rows.select("o_orderkey", "o_orderdate", "segment", "action", held.alias("held"), (before("retain_days") & ~held).alias("expired"), (before("retain_days + grace_days") & ~held & (F.col("action") == "hard_delete")).alias("gone"))


@query(f"with {_KEPT_SQL} select o_orderkey, segment, expired and not gone as soft_deleted from aged where expired")
def retention_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aged(spark, sf_dir).where("expired").select("o_orderkey", "segment", F.expr("expired and not gone").alias("soft_deleted"))


@query(f"with {_KEPT_SQL} select segment, count(*) as kept, count(*) filter (held) as held, count(*) filter (expired) as hidden from aged where not gone group by segment")
def retention_hard_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aged(spark, sf_dir).where("not gone").groupBy("segment").agg(F.count("*").alias("kept"), F.count_if("held").alias("held"), F.count_if("expired").alias("hidden"))


@query("select o_custkey, string_agg(o_orderkey, ',' order by o_orderkey) as scope from (select distinct o_custkey, o_orderkey from orders where o_orderkey % 50 = 0 or o_totalprice > 400000) group by o_custkey")
def legal_hold_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two holds' ids per owner, sorted."""
    o = table(spark, sf_dir, "orders")
    own = o.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey"))).alias("a"), F.collect_set(F.when(F.col("o_totalprice") > 400000, F.col("o_orderkey"))).alias("b"))
    return own.select("o_custkey", F.sort_array(F.array_union("a", "b")).alias("ids")).where(F.size("ids") > 0).select("o_custkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("scope"))


@query(f"select user_id, max({_E}) as last_event, bool_or(event_type = 'error') as deleted, coalesce(arg_max(event_id, event_id) filter (event_type = 'error'), -1) as tombstone, count(*) as events from events group by user_id")
def source_event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(epoch("ts")).alias("last_event"), F.bool_or(error).alias("deleted"), F.coalesce(F.max(F.when(error, F.col("event_id"))), F.lit(-1)).alias("tombstone"), F.count("*").alias("events"))


RULES = {"price_positive": "o_totalprice > 0", "status_domain": "o_orderstatus in ('F', 'O')", "held_not_old": "not (o_orderkey % 50 = 0 and o_totalprice > 300000)", "owner_present": "o_custkey is not null"}


@query("select rule, cast(count(*) as bigint) as violations from (" + " union all ".join(f"select '{n}' as rule from orders where not ({c})" for n, c in RULES.items()) + ") group by rule")
def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared invariants as counts of rows that break them, in one scan; rules without any have no row."""
    sums = table(spark, sf_dir, "orders").agg(*[F.count_if(~F.expr(c)).alias(n) for n, c in RULES.items()])
    return sums.unpivot([], list(RULES), "rule", "violations").where("violations > 0")


@query("select strftime(date_trunc('month', o_orderdate), '%Y%m') as partition_name, count(*) as n, cast(date_trunc('month', o_orderdate) + interval 1 month <= timestamp '1995-01-01' as boolean) as droppable from orders group by all")
def monthly_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc("o_orderdate", "month")
    return table(spark, sf_dir, "orders").groupBy(month.alias("m")).agg(F.count("*").alias("n")).select(F.date_format("m", "yyyyMM").alias("partition_name"), "n", (F.add_months("m", 1) <= F.lit("1995-01-01").cast("date")).alias("droppable"))
