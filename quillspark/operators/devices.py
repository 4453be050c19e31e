"""Devices: their status as it is patched over defaults, and their revocation by an administrator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The reason where none is given, and the longest kept.
REASON, LONGEST = "revoked by administrator", 1000


def patched(patches: DataFrame, defaults: dict[str, str | None]) -> DataFrame:
    """device and each field of `defaults`: the value of the last patch that has the field, even if it is null there; else the default.

    Patches are device, at, fields (a map of text). Fields that aren't known are left out, a null map patches nothing, of patches at
    one time the largest value counts (null last), and rows without a device or time take no part. A device is one row after partial
    aggregation, however many patches it has.
    """
    sound = patches.where(F.col("device").isNotNull() & F.col("at").isNotNull())
    last = lambda f: F.max(F.when(F.map_contains_key("fields", f), F.struct(F.col("at"), F.element_at("fields", f).alias("value"))))
    states = sound.groupBy("device").agg(*(last(f).alias(f) for f in defaults))
    return states.select("device", *(F.when(F.col(f).isNull(), F.lit(d)).otherwise(F.col(f)["value"]).alias(f) for f, d in defaults.items()))


def revocations(devices: DataFrame, requests: DataFrame) -> DataFrame:
    """request, device, status of each request (request, device, organization, at, reason): revoked, or not_found where the device is unknown
    or another organization's, between which the answer must not tell."""
    own = devices.select("device", F.col("organization").alias("_own")).dropDuplicates(["device"])
    found = F.coalesce(F.col("organization") == F.col("_own"), F.lit(False))
    return requests.join(own, "device", "left").select("request", "device", F.when(found, "revoked").otherwise("not_found").alias("status"))


def revoked(devices: DataFrame, requests: DataFrame) -> DataFrame:
    """devices (device, organization, refresh_token_hash, session_id, revoked_at, revoked_reason) after all requests of their own
    organization: the last one's time and reason stand (of equal times the largest reason), and credentials are gone. Requests are
    aggregated before they meet the devices; rows with nulls as keys change nothing."""
    asked = F.struct("at", F.substring(F.coalesce(F.when(F.col("reason") != "", F.col("reason")), F.lit(REASON)), 1, LONGEST).alias("reason"))
    last = requests.groupBy("device", "organization").agg(F.max(asked).alias("_x"))
    gone, kept = F.col("_x").isNotNull(), lambda c: F.when(F.col("_x").isNull(), F.col(c))
    new = {"refresh_token_hash": kept("refresh_token_hash"), "session_id": kept("session_id"), "revoked_at": F.when(gone, F.col("_x.at")).otherwise(F.col("revoked_at")), "revoked_reason": F.when(gone, F.col("_x.reason")).otherwise(F.col("revoked_reason"))}
    return devices.join(last, ["device", "organization"], "left").withColumns(new).drop("_x")
