"""Writers of the archive, each read back: raw documents, dumps, backups and their restoration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import objects as O
from ..operators.numbering import numbered
from ..sources.files import copied, deleted, exists, manifest
from ..sources.pulls import page_events
from ..sources.tables import epoch, table
from ..sources.upstream import OVERLAP, Upstream, pulled
from ..streaming.events import scratch
from .operations import _E, AS_OF
from .registry import query

_BODY = """'{"schema_version":"1.0","source":"pull","source_event_id":"e' || event_id || '","event_time":' || secs || ',"kind":"' || event_type || '","is_deletion":' || case when event_type = 'error' then 'true' else 'false' end || ',"integrity":{"payload_sha256":"' || sha256(props) || '"}}'"""


def documents(events: DataFrame) -> DataFrame:
    """event_id, day, object_key, body: the raw document of each source event."""
    own = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    body = F.struct(
        F.lit("1.0").alias("schema_version"), F.lit("pull").alias("source"), own.alias("source_event_id"), epoch("ts").alias("event_time"), F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("is_deletion"),
        F.struct(F.sha2("props", 256).alias("payload_sha256")).alias("integrity"),
    )
    key = O.compliance_key(F.concat(F.lit("w"), F.col("user_id").cast("string")), own, F.col("ts"))
    return events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), key.alias("object_key"), F.to_json(body).alias("body"))


@query(f"""with e as (select *, {_E} as secs from events) select event_id, 'raw/compliance/' || strftime(ts, 'year=%Y/month=%m/day=%d') || '/workspace=w' || user_id || '/e' || event_id || '.json' as object_key, sha256({_BODY}) as body_sha256 from e""")
def compliance_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(table(spark, sf_dir, "events")).select("event_id", "object_key", F.sha2("body", 256).alias("body_sha256"))


@query(f"""with e as (select *, {_E} as secs from events) select strftime(ts, '%Y-%m-%d') as day, count(*) as events, count(*) filter (event_id % 3 = 0) as marked_before, min(event_id) filter (event_id % 3 <> 0) as first_back_filled, true as all_marked,
 sha256(string_agg(sha256({_BODY}), ',' order by event_id) filter (event_id % 3 <> 0)) as content from e group by 1""")
def archive_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events is marked as archived; the others are written by day, read back, and marked by what is found."""
    folder = scratch(spark)
    every = documents(table(spark, sf_dir, "events"))
    marked = every.where(F.col("event_id") % 3 == 0).select("event_id")
    every.join(marked, "event_id", "left_anti").write.partitionBy("day").json(f"{folder}/documents")
    found = spark.read.schema("event_id long, object_key string, body string").json(f"{folder}/documents").select("event_id", F.sha2("body", 256).alias("digest"))
    marks = every.select("event_id", "day").join(marked.withColumn("before", F.lit(True)), "event_id", "left").join(found, "event_id", "left")
    own = F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("event_id", "digest"))))
    days = marks.groupBy("day").agg(F.count("*").alias("events"), F.count("before").alias("marked_before"), F.min(F.when(F.col("digest").isNotNull(), F.col("event_id"))).alias("first_back_filled"), F.bool_and(F.col("before").isNotNull() | F.col("digest").isNotNull()).alias("all_marked"), own.alias("own"))
    return days.withColumn("content", F.sha2(F.array_join(F.transform("own", lambda x: x["digest"]), ","), 256)).drop("own")


_SINCE, _UNTIL = AS_OF - 10 * 86400, AS_OF - 5 * 86400


@query(f"select event_type, count(*) as n, min(event_id) as first_event, max(props) as last_props from events where {_E} between {_SINCE} and {_UNTIL} group by event_type")
def time_slice_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of time as CSV with a header, read back."""
    folder = scratch(spark)
    table(spark, sf_dir, "events").where(epoch("ts").between(_SINCE, _UNTIL)).select("event_id", "event_type", "props").write.option("header", True).option("escape", '"').csv(f"{folder}/slice")
    back = spark.read.schema("event_id long, event_type string, props string").option("header", True).option("escape", '"').csv(f"{folder}/slice")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("props").alias("last_props"))


BACKED_UP = ["region", "nation", "customer", "conversations"]


@query(" union all ".join(f"select '{n}' as table_name, count(*) as rows_before, count(*) as rows_after, true as verified, false as left_over from {n}" for n in BACKED_UP))
def backup_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables dumped with a manifest, copied, verified by size and digest against it, counted before and after, and the first dump deleted."""
    folder, out = scratch(spark), []
    for name in BACKED_UP:
        before = table(spark, sf_dir, name)
        before.write.parquet(f"{folder}/dump/{name}")
        manifest(spark, f"{folder}/dump/{name}").write.parquet(f"{folder}/manifest/{name}")
    copied(spark, f"{folder}/dump", f"{folder}/restored")
    deleted(spark, f"{folder}/dump")
    left_over = deleted(spark, f"{folder}/dump")  # nothing any more
    for name in BACKED_UP:
        stored = manifest(spark, f"{folder}/restored/{name}").select("file", F.col("bytes").alias("found"), F.col("sha256").alias("digest"))
        checks = spark.read.parquet(f"{folder}/manifest/{name}").join(stored, "file", "full")
        same = F.bool_and(F.coalesce((F.col("bytes") == F.col("found")) & (F.col("sha256") == F.col("digest")), F.lit(False)))
        rows = [d.agg(F.count("*").alias(c)) for d, c in ((table(spark, sf_dir, name), "rows_before"), (spark.read.parquet(f"{folder}/restored/{name}"), "rows_after"))]
        out.append(rows[0].crossJoin(rows[1]).crossJoin(checks.agg(same.alias("verified"))).select(F.lit(name).alias("table_name"), "*", F.lit(left_over).alias("left_over")))  # one row each
    return reduce(DataFrame.unionByName, out)


_PULL_SINCE, _PULL_UNTIL, _PULL_WINDOW, _PAGE = AS_OF - 20 * 86400, AS_OF, 5 * 86400, 100


def _item() -> Column:
    """An event as the upstream of upstream_pull has it."""
    return F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("conversation_id"))


def served(events: DataFrame, folder: str, item: Column | None = None, items: str = "items", size: int = _PAGE) -> None:
    """Events as the pages of an upstream, by window and cursor: since-cursor.json in a folder, written by the tasks that hold them."""
    at = epoch("ts")
    start = F.greatest(F.floor((at - _PULL_SINCE) / _PULL_WINDOW) * _PULL_WINDOW + _PULL_SINCE, F.lit(_PULL_SINCE))
    since = F.when(start == _PULL_SINCE, start - OVERLAP).otherwise(start)
    rows = numbered(events.withColumn("since", since).where(at.between(_PULL_SINCE - OVERLAP, _PULL_UNTIL - 1)), "since", "event_id").withColumn("page", F.floor(F.col("number") / size))
    pages = rows.groupBy("since", "page").agg(F.collect_list(_item() if item is None else item).alias(items))  # at most `size` each
    last = rows.groupBy("since").agg(F.max("page").alias("last"))
    body = F.to_json(F.struct(items, (F.col("page") + 1).cast("string").alias("next_cursor"), (F.col("page") < F.col("last")).alias("has_more")))
    named = pages.join(last, "since").select(F.concat(F.col("since").cast("string"), F.lit("-"), F.when(F.col("page") > 0, F.col("page").cast("string")).otherwise(""), F.lit(".json")).alias("name"), body.alias("body"))

    def put(batches):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        for b in batches:
            for name, text in zip(b["name"], b["body"], strict=True):
                with system.open_output_stream(f"{path}/{name}") as f:
                    f.write(text.encode())
            yield b[["name"]]

    named.mapInPandas(put, "name string").count()


@query(f"""select 'e' || event_id as source_event_id, 'other' as kind, {_E} as at, 'c' || user_id as conversation_id from events where {_E} between {_PULL_SINCE - OVERLAP} and {_PULL_UNTIL - 1}""")
def upstream_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pull in two steps, each in as many reads as the cap on pages makes of it. In the first, one window's second page is not there: what
    came before it stays, with the failure. The second goes on behind the windows that are whole; events that come twice are dropped by their id."""
    folder = scratch(spark)
    served(table(spark, sf_dir, "events"), f"{folder}/pages")
    spark.dataSource.register(Upstream)
    hidden, away = f"{folder}/pages/{_PULL_SINCE + _PULL_WINDOW}-1.json", f"{folder}/away.json"
    broken = copied(spark, hidden, away) and deleted(spark, hidden) if exists(spark, hidden) else False
    read = lambda since, name: pulled(spark, f"{folder}/{name}", address=f"{folder}/pages/{{since}}-{{cursor}}.json", since=since, until=_PULL_UNTIL, window=_PULL_WINDOW, overlap=OVERLAP if since == _PULL_SINCE else 0, attempts=2, pause=0.01, fields='{"items": "items"}')
    first = read(_PULL_SINCE, "first")
    failed = first.where(F.col("error").isNotNull()).agg(F.min("window_start")).first()[0]
    pulls = [first]
    if failed is not None:
        if broken:
            copied(spark, away, hidden)
        pulls.append(read(failed + (OVERLAP if failed < _PULL_SINCE else 0), "second"))
    every = reduce(DataFrame.unionByName, pulls).where(F.col("source_event_id").isNotNull())
    items = F.struct(F.col("source_event_id").alias("id"), "type", "created_at", "conversation_id", F.lit(None).cast("string").alias("actor"), "raw")
    parsed = page_events(every.select(F.array(items).alias("items")))
    return parsed.groupBy("source_event_id").agg(F.min_by(F.struct("kind", "event_time", "conversation_id"), "event_time").alias("x")).select("source_event_id", "x.kind", F.unix_seconds("x.event_time").alias("at"), "x.conversation_id")
