"""The upstream pulled as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.polling import admitted_events, cursors
from ..sources.tables import table
from ..sources.upstream import OVERLAP, Upstream
from ..sources.upstream import PAGES as MOST_PAGES
from ..streaming.events import scratch
from .operations import _E
from .registry import query
from .transfers import _PULL_SINCE, _PULL_UNTIL, _PULL_WINDOW, served

#: Types of the derived upstream: an event has the one of its id.
TYPES = ("message.created", "conversation.renamed", "File.uploaded", "message.deleted", "login", "chat.opened", "retention.purge")
SIZE, PAGES = 500, 2
_TYPE = f"[{', '.join(map(repr, TYPES))}][event_id % {len(TYPES)} + 1]"


def _item():
    """An event of a derived upstream, with an actor, a flag and times of several kinds."""
    text = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    time = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format(F.expr("ts + interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    return F.struct(
        text("e", "event_id").alias("id"), F.element_at(F.array(*map(F.lit, TYPES)), (F.col("event_id") % len(TYPES) + 1).cast("int")).alias("type"), F.coalesce(time, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("created_at"), text("c", "user_id").alias("conversation_id"),
        F.when(F.col("event_id") % 2 == 0, text("m", "event_id")).alias("message_id"), text("w", "user_id").alias("workspace_id"), F.struct(text("u", "user_id").alias("email")).alias("user"), (F.col("event_id") % 11 == 0).alias("deleted"),
    )


@query(f"""with e as (select *, {_E} as secs, {_TYPE} as type from events where {_E} between {_PULL_SINCE - OVERLAP} and {_PULL_UNTIL - 1}),
 s as (select *, case when secs < {_PULL_SINCE} then {_PULL_SINCE} else (secs - {_PULL_SINCE}) // {_PULL_WINDOW} * {_PULL_WINDOW} + {_PULL_SINCE} end as since from e), w as (select since, count(*) as n from s group by since)
 select 'e' || event_id as source_event_id, case when event_id % 7 in (3, 6) then 'deletion' when event_id % 7 = 0 then 'message' when event_id % 7 in (1, 5) then 'conversation' when event_id % 7 = 2 then 'file' else 'unknown' end as kind,
 secs as at, 'c' || user_id as conversation_id, case when event_id % 2 = 0 then 'm' || event_id end as message_id, 'w' || user_id as workspace_id, 'u' || user_id as actor, event_id % 11 = 0 or event_id % 7 = 3 as is_deletion,
 cast(ceil(n / {SIZE}) as bigint) as pages, cast(n as bigint) as events from s join w using (since)""")
def upstream_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pull in cycles, the first of at most PAGES pages a window, and twice as many in each where there are more: the first in a run of its
    own, the others by another run that goes on from its checkpoint and cursors. With each event stands what its window's cursor has seen."""
    folder = scratch(spark)
    served(table(spark, sf_dir, "events"), f"{folder}/pages", _item(), "data", SIZE)
    spark.dataSource.register(Upstream)
    options = {"address": f"{folder}/pages/{{since}}-{{cursor}}.json", "since": _PULL_SINCE, "until": _PULL_UNTIL, "window": _PULL_WINDOW, "overlap": OVERLAP, "pages": PAGES, "most_pages": MOST_PAGES, "attempts": 2, "pause": 0.01, "state": f"{folder}/cursors"}
    for trigger in ({"availableNow": True}, {"processingTime": "0 seconds"}):
        stream = spark.readStream.format("upstream").options(**options).load()
        running = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/check").trigger(**trigger).start()
        if "availableNow" in trigger:
            running.awaitTermination()
        else:
            running.processAllAvailable()
            running.stop()
    rows = spark.read.parquet(f"{folder}/rows")
    windows = cursors(spark, f"{folder}/cursors").select("start", F.col("page").cast("long").alias("pages"), "events")  # a row a window
    start = F.greatest(F.floor((F.col("at") - _PULL_SINCE) / _PULL_WINDOW) * _PULL_WINDOW + _PULL_SINCE, F.lit(_PULL_SINCE))
    start = F.when(start == _PULL_SINCE, start - OVERLAP).otherwise(start)
    events = admitted_events(rows).withColumn("at", F.unix_seconds("event_time")).withColumn("start", start)
    return events.join(windows, "start").select("source_event_id", "kind", "at", "conversation_id", "message_id", "workspace_id", "actor", "is_deletion", "pages", "events")
