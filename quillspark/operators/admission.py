"""Admission against all keys that were ever claimed, and the results that replays get back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.keyed import Keyed

#: A claimed key, with the arrival that claimed it and what came of it.
CLAIM = "key string, arrival bigint, result string"


def admitted(store: Keyed, batch: DataFrame, stream: str | None = None, number: int = 0) -> DataFrame:
    """key, arrival, outcome, result of each row of a batch (key, arrival, result): the first of a key claims it, any other row is replayed and
    gets the claim's result. A batch that is given again, as the same number of its stream or anew, has the outcomes it had.

    Only buckets that the batch has keys of are read. Rows with a null key claim nothing and have nulls.
    """
    claims = batch.where(F.col("key").isNotNull()).groupBy("key").agg(F.min_by(F.struct("arrival", "result"), "arrival").alias("x")).select("key", "x.arrival", "x.result")
    store.change(lambda now: claims.join(now.select("key"), "key", "left_anti"), claims, append=True, batch=None if stream is None else (stream, number))
    known = store.read(store.touched(claims)).select("key", F.col("arrival").alias("_claimed"), F.col("result").alias("_result"))
    outcome = F.when(F.col("_claimed") == F.col("arrival"), "admitted").when(F.col("_claimed").isNotNull(), "replayed")
    return batch.select("key", "arrival").join(known, "key", "left").select("key", "arrival", outcome.alias("outcome"), F.col("_result").alias("result"))
