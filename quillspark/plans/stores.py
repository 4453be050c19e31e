"""Tables that grow: conversations, snapshots, claimed keys and archived events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission as A
from ..operators import capture as C
from ..operators import conversations as V
from ..operators import identity as I
from ..operators import snapshots as S
from ..sources.keyed import Keyed
from ..sources.tables import table
from ..streaming import archive as R
from ..streaming.events import scratch, stream_of
from .registry import query
from .sql import LOG
from .transfers import _BODY, _E, documents

_LEVELS = "['unknown', 'live_only', 'partial_scroll_limit', 'complete_current_page', 'reconciled', 'compliance_verified']"
#: A turn as a request to upsert its conversation: some fields are missing or empty.
_REQUEST = {
    "conversation": "cast(conv_id as {text})", "at": "cast(turn as bigint)", "title": "case when role = 'user' then substr(text, 1, 60) when turn % 4 = 3 then '' end", "url": "case when turn % 3 = 0 then concat('https://e.org/c/', conv_id, '?t=', turn) end",
    "model": "case when role = 'assistant' then concat('m', turn % 4) else '' end", "user": "case when turn > 0 then concat('u', (conv_id + turn) % 50) end", "level": "(conv_id * 3 + turn * 5) % 6", "created": "case when conv_id % 2 = 1 then 1000 + cast(turn as bigint) end",
    "updated": "case when turn % 5 < 2 then 2000 + cast(turn as bigint) end", "source": "case (conv_id + turn) % 5 when 0 then 'compliance' when 4 then 'import' else 'chrome_extension' end",
}
_ROWS = ", ".join(f'{e.format(text="varchar")} as "{c}"' for c, e in _REQUEST.items())
_CLEAN = r"trim(substr(regexp_replace(regexp_replace(title, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), '[ \t]+', ' ', 'g'), 1, 2048), E' \t\n\r')"


@query(
    f"""with r as (select {_ROWS} from conversations), k as (select *, case when level = 5 and source <> 'compliance' then 0 else level end as rank from r),
 s as (select conversation, string_agg(source, ',' order by first, source) as sources from (select conversation, source, min("at") as first from k group by all) group by conversation)
 select conversation, arg_max({_CLEAN}, "at") filter (title <> '') as title, arg_max(url, "at") filter (url <> '') as url, arg_max(model, "at") filter (model <> '') as model, coalesce(arg_max(updated, "at") filter (updated is not null), -1) as updated,
 arg_min("user", "at") filter ("user" is not null) as "user", coalesce(max(created) filter ("at" = first_at), -1) as created, {_LEVELS}[max(rank) + 1] as completeness, min("at") as first_at, max("at") as last_at, any_value(sources) as sources
 from (select *, min("at") over (partition by conversation) as first_at from k) join s using (conversation) group by conversation"""
)
def conversation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in three batches that cut across conversations, the first of them given twice, merged one by one into a table of states. -1 stands for no time."""
    level = F.element_at(F.expr(_LEVELS.replace("[", "array(").replace("]", ")")), (F.col("level") + 1).cast("int"))
    requests = table(spark, sf_dir, "conversations").selectExpr(*(f"{e.format(text='string')} as `{c}`" for c, e in _REQUEST.items())).withColumn("completeness", level)
    store = Keyed(spark, scratch(spark), V.STATE, "conversation")
    for part in (2, 0, 1, 2):
        new = V.merged(V.states(requests.where(F.pmod(F.xxhash64("conversation", "at"), F.lit(3)) == part)))
        store.change(lambda now, new=new: V.merged(now, new), new)
    return V.rows(store.read()).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("created", "updated")})


_SNAPSHOT = "'{' || '\"conv_id\":' || conv_id || ',\"versions\":\"' || string_agg(turn || ':' || version_number || ':' || digest, ',' order by turn, version_number) || '\"}'"


@query(
    f"""with {LOG}, a as (select * from admitted where rank <= 4), c as (select conv_id, turn, digest, min(arrival) as first_arrival from a group by all), n as (select *, row_number() over (partition by conv_id, turn order by first_arrival) as version_number from c),
 v as (select conv_id, 1 + count(distinct rank) filter (rank > 2) as snapshot_version, max(arrival) as changed from a group by conv_id)
 select conv_id, cast(snapshot_version as bigint) as snapshot_version, 'snapshots/conversation=' || conv_id || '/v' || lpad(cast(snapshot_version as varchar), 6, '0') || '.json' as object_key, changed, changed as covered, sha256(body) as sha256, true as verified
 from v join (select conv_id, {_SNAPSHOT} as body from n group by conv_id) using (conv_id)"""
)
def snapshot_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures arrive in three steps. The second arrives while snapshots of the first are being written, so what it changes stays stale;
    in the end two writers meet, of which one wins. Bodies are read back and compared with their marks."""
    log = C.admitted(C.capture_log(spark, sf_dir).where("rank <= 4"))
    folder = scratch(spark)
    store = Keyed(spark, f"{folder}/state", S.STATE, "conv_id")

    def build(rows: DataFrame) -> DataFrame:
        """Versions of what had arrived, in order of turns."""
        seen = I.versions(log.join(rows, "conv_id").where("arrival <= changed").drop("changed"))
        entry = F.concat(F.col("turn").cast("string"), F.lit(":"), F.col("version_number").cast("string"), F.lit(":"), F.col("digest"))
        own = seen.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "version_number", entry.alias("entry")))).alias("x"))
        return own.select("conv_id", F.to_json(F.struct("conv_id", F.array_join(F.transform("x", lambda e: e["entry"]), ",").alias("versions"))).alias("body"))

    arrive = lambda low, high: S.arrived(store, log.where(F.col("rank").between(low, high)))
    write = lambda during=lambda: None: S.write_snapshots(store, f"{folder}/objects", build, during)
    arrive(0, 2)
    write()
    arrive(3, 3)
    write(lambda: arrive(4, 4))
    write(write)
    return S.read_back(store, f"{folder}/objects").select("conv_id", "snapshot_version", "object_key", "changed", "covered", "sha256", "verified")


@query(f"with {LOG}, k as (select *, case when rank <= 2 then 0 when rank <= 4 then 1 else 2 end as batch from outcomes where outcome <> 'rejected') select key, arrival, batch, outcome, first_value(digest) over (partition by key order by arrival) as result from k")
def admission_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures in three batches, each against all keys claimed before; the second is given again as the batch it was. Replays get what came
    of the first."""
    valid = C.hashed(C.checked(C.capture_log(spark, sf_dir)).where("reject_reason is null"))
    store = Keyed(spark, scratch(spark), A.CLAIM, "key")
    parts = []
    for number, ranks in ((0, (0, 2)), (1, (3, 4)), (1, (3, 4)), (2, (5, 6))):
        out = A.admitted(store, valid.where(F.col("rank").between(*ranks)).select("key", "arrival", F.col("digest").alias("result")), "captures", number)
        parts = [p for p in parts if p[0] != number] + [(number, out)]
    first, *rest = [out.withColumn("batch", F.lit(n)) for n, out in parts]
    for out in rest:
        first = first.unionByName(out)
    return first.select("key", "arrival", "batch", "outcome", "result")


@query(f"""with e as (select *, {_E} as secs from events) select event_id, 'raw/compliance/' || strftime(ts, 'year=%Y/month=%m/day=%d') || '/workspace=w' || user_id || '/e' || event_id || '.json' as object_key, sha256({_BODY}) as body_sha256, true as verified from e""")
def archive_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's raw documents, each with a pointer; the stream delivers every event twice."""
    folder = scratch(spark)
    store = Keyed(spark, f"{folder}/pointers", R.POINTER, "event_id")
    sink = stream_of(spark, sf_dir, times=2).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/check")
    sink.foreachBatch(R.archiving(store, f"{folder}/objects", documents)).start().awaitTermination()
    return R.archived(store, f"{folder}/objects").select("event_id", "object_key", F.sha2("body", 256).alias("body_sha256"), (F.sha2("body", 256) == F.col("sha256")).alias("verified"))
