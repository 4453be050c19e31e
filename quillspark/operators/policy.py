"""Which workspaces may be captured: gates, then ordered rules of which the first that fails decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signals that a client may report, and those that prove which workspace it is.
KNOWN_SIGNALS = ("workspace_label_match", "workspace_id_match", "account_switcher_managed_badge", "managed_account_url_path", "enterprise_workspace_marker")
STRONG_SIGNALS = ("workspace_id_match", "workspace_label_match")


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def capture_gate(attachments: bool = False) -> Column:
    """Why nothing may be captured now, of the columns kill_switch, capture_enabled, authorized (and attachments_enabled); else null. What isn't set is off."""
    code = F.when(_true("kill_switch"), "kill_switch_active").when(~_true("capture_enabled"), "capture_disabled").when(~_true("authorized"), "authorization_not_confirmed")
    return code.when(~_true("attachments_enabled"), "attachments_disabled") if attachments else code


def workspace_reason() -> Column:
    """Why a workspace is accepted or refused, of the columns kind, verified, signals, workspace_id, label, and the configured
    allowed_ids and allowed_label. A personal one is refused before anything else; where nothing is configured all are. Listed ids
    decide alone; a label counts only where no id is listed."""
    text = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    ids = F.filter(F.transform(F.coalesce("allowed_ids", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    label = F.lower(text("allowed_label"))
    strong = F.arrays_overlap(F.coalesce("signals", F.array().cast("array<string>")), F.array(*map(F.lit, STRONG_SIGNALS)))
    strong = F.coalesce(strong, F.lit(False))
    by_id = F.when(~F.array_contains(ids, text("workspace_id")) | (text("workspace_id") == ""), "workspace_not_allowlisted").when(~strong, "workspace_signal_missing").otherwise("workspace_id_allowlisted")
    by_label = F.when((F.lower(text("label")) == "") | (F.lower(text("label")) != label), "workspace_label_mismatch").when(~strong, "workspace_signal_missing").otherwise("workspace_label_matched")
    return (
        F.when(F.col("kind") == "personal", "personal_workspace_blocked")
        .when(F.coalesce(F.col("kind"), F.lit("")) != "managed_company", "workspace_unverified")
        .when(~_true("verified"), "workspace_unverified")
        .when((F.size(ids) == 0) & (label == ""), "workspace_policy_unconfigured")
        .when(F.size(ids) > 0, by_id)
        .otherwise(by_label)
    )


def accepted(reason: Column) -> Column:
    return reason.isin("workspace_id_allowlisted", "workspace_label_matched")
