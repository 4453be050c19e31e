"""The capture log, its validation and exactly-once admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..sources.tables import table


def capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures derived from conversations: partial and truncated ones before the base, then shifted backfills, edits, replays
    and one wrong checksum. One scan, each row exploded into the captures it gives."""
    sid = "case when turn % 2 = 0 then concat('c', conv_id, '-m', turn) end"
    kinds = [  # (rank, when, text, sequence, source id, status, key suffix)
        (0, "role = 'assistant' and (conv_id + turn) % 9 = 0", "text", "turn", sid, "partial", "-6"),
        (1, "role = 'assistant' and (conv_id + turn) % 7 = 0", "substring(text, 1, cast(length(text) div 2 as int))", "turn", sid, "partial", "-3"),
        (2, "true", "text", "turn", sid, "complete", "-0"),
        (3, "conv_id % 3 = 0", "text", "turn + 2", "cast(null as string)", "complete", "-1"),
        (4, "conv_id % 5 = 0 and role = 'user' and turn % 2 = 0", "concat(text, ' (edited)')", "turn", sid, "complete", "-2"),
        (5, "conv_id % 4 = 0", "text", "turn", sid, "complete", "-0"),
        (6, "conv_id % 11 = 0 and turn = 0", "text", "turn", sid, "complete", "-5"),
    ]
    made = ", ".join(f"struct({r} as rank, {when} as ok, {text} as text, cast({seq} as bigint) as seq, {source} as source_id, '{status}' as status, '{suffix}' as suffix)" for r, when, text, seq, source, status, suffix in kinds)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(f"explode(filter(array({made}), x -> x.ok))").alias("x"))
    return rows.select(
        "conv_id", "turn", "role", "x.rank", "x.text", "x.seq", "x.source_id", "x.status",
        F.expr("concat('capture:', conv_id, '-', turn, x.suffix)").alias("key"),
        F.expr("x.rank * 1000000000L + conv_id * 1000 + turn").alias("arrival"),
        F.expr("case when x.rank = 6 then sha2(concat(x.text, 'x'), 256) else sha2(x.text, 256) end").alias("declared"),
    )


def checked(log: DataFrame) -> DataFrame:
    """reject_reason by the first rule that fails; null for valid captures. Nothing is dropped."""
    reason = (
        F.when(~F.col("key").rlike(r"^[A-Za-z0-9._:-]{8,128}$"), "bad_key")
        .when(~F.col("role").isin("user", "assistant", "tool", "system"), "bad_role")
        .when(F.length("text") > 1_000_000, "too_long")
        .when((F.col("role") == "user") & (F.col("status") == "partial"), "partial_user")
        .when(F.sha2("text", 256) != F.col("declared"), "checksum_mismatch")
    )
    return log.withColumn("reject_reason", reason)


def outcomes(log: DataFrame) -> DataFrame:
    """Each capture as rejected, replayed (its key came before) or admitted."""
    first = F.row_number().over(Window.partitionBy("key", F.col("reject_reason").isNull()).orderBy("arrival"))
    out = F.when(F.col("reject_reason").isNotNull(), "rejected").when(first > 1, "replayed").otherwise("admitted")
    return checked(log).withColumn("outcome", out)


def admitted(log: DataFrame) -> DataFrame:
    return outcomes(log).where("outcome = 'admitted'").drop("reject_reason", "outcome")


def hashed(log: DataFrame) -> DataFrame:
    return log.withColumn("digest", content_hash(F.col("text")))
