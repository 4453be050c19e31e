"""Which message each capture belongs to, and the versions and pointers that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import capture as C
from ..operators import identity as I
from .registry import query
from .sql import RESOLVED


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = C.hashed(C.admitted(C.capture_log(spark, sf_dir)))
    return hashed.withColumn("fingerprint", T.fingerprint(F.col("conv_id"), F.col("role"), F.col("digest"), F.col("seq"), F.lit(0)))


@query(f"{RESOLVED} select conv_id, arrival, message, layer, version_number, outcome from resolved")
def resolved_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each admitted capture: its message, the layer that found it, and what it did there."""
    return I.resolved(_captures(spark, sf_dir)).select("conv_id", "arrival", "message", "layer", "version_number", "outcome")


@query(f"""{RESOLVED} select conv_id, message, version_number, digest, first_arrival, captures, version_status, version_number > 1 and role = 'user' as is_edit, version_number > 1 and role = 'assistant' as is_regeneration,
 coalesce(case when version_status = 'partial' then max(case when version_status <> 'partial' then version_number end) over (partition by conv_id, message) end, 0) as superseded_by,
 char_count, greatest(1, char_count // 4) as token_estimate from numbered""")
def message_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions by resolved message. Captures are small without their texts, whose sizes are joined by arrival afterwards."""
    captures = _captures(spark, sf_dir)
    sizes = captures.select(F.col("arrival").alias("first_arrival"), F.length("text").cast("long").alias("char_count"))
    v = I.message_versions(I.resolved(captures)).drop("role").join(sizes, "first_arrival")
    return v.withColumn("token_estimate", F.greatest(F.lit(1), F.floor(F.col("char_count") / 4)).cast("long"))


@query(f"{RESOLVED} select * from messages")
def resolved_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as they stand after all captures, with the pointer to the current version."""
    return I.messages(I.resolved(_captures(spark, sf_dir)))
