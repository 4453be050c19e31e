"""Attachments from their announcement to their verified bytes: each transition takes rows and gives their next state.

A row has what was declared (filename, mime, byte_size, sha256, metadata_only) and, as it goes on, state, reason, and the times and objects
that the transitions need. States are pending, quarantine, clean, rejected, expired and metadata_only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_filename

_OFFICE = "application/vnd.openxmlformats-officedocument."
DOCUMENT, SHEET, SLIDES = _OFFICE + "wordprocessingml.document", _OFFICE + "spreadsheetml.sheet", _OFFICE + "presentationml.presentation"
#: Kinds that are taken with their extensions, first bytes in hexadecimal in the order they are tried, kinds that are text.
ALLOWED = {
    "image/png": (".png",), "image/jpeg": (".jpg", ".jpeg"), "image/webp": (".webp",), "image/gif": (".gif",), "application/pdf": (".pdf",), "text/plain": (".txt", ".log", ".md"), "text/csv": (".csv",), "text/markdown": (".md",),
    "application/json": (".json",), DOCUMENT: (".docx",), SHEET: (".xlsx",), SLIDES: (".pptx",),
}
MAGIC = (("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("52494646", "image/webp"), ("255044462D", "application/pdf"), ("504B0304", DOCUMENT))
TEXTUAL = ("text/plain", "text/csv", "text/markdown", "application/json")
#: Seconds after the end of an upload's window in which it may still be completed, and after which it is given up.
GRACE, GIVEN_UP = 15 * 60, 60 * 60
#: Bytes of a text that are decoded to see whether it is one.
SAMPLE = 1 << 16


def extension(name: Column) -> Column:
    """The last extension of a name, lower-case with its dot; empty if none."""
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise("")


def refusal(most_bytes: int) -> Column:
    """Why an announcement is refused; null if it isn't."""
    kinds = F.create_map(*[x for kind, own in ALLOWED.items() for x in (F.lit(kind), F.array(*map(F.lit, own)))])
    own = F.try_element_at(kinds, F.coalesce("mime", F.lit("")))
    return F.when(F.col("byte_size") > most_bytes, "attachment_too_large").when(own.isNull(), "mime_type_not_allowed").when(~F.array_contains(own, extension(safe_filename(F.col("filename")))), "extension_mismatch")


def announced(rows: DataFrame, most_bytes: int) -> DataFrame:
    """Adds refused, duplicate, and the state after the announcement. `before` is the state that an earlier one of the same attachment has left
    (null: none): what is clean, in quarantine or metadata only stays; all else starts again as pending."""
    code = refusal(most_bytes)
    kept = F.coalesce(F.col("before").isin("clean", "quarantine", "metadata_only"), F.lit(False))
    state = F.when(code.isNotNull() | kept, F.col("before")).when(F.coalesce("metadata_only", F.lit(False)), "metadata_only").otherwise("pending")
    return rows.withColumns({"refused": code, "duplicate": code.isNull() & kept, "state": state})


def _step(rows: DataFrame, rules: list[tuple[Column, str | None, str | Column | None]], applies: Column) -> DataFrame:
    """Of rows that a transition applies to, the first rule (condition, state, reason) that holds sets both; no state leaves it."""
    state, reason = F.when(~applies, F.col("state")), F.when(~applies, F.col("reason"))
    for condition, to, why in rules:
        holds = F.coalesce(condition, F.lit(False))
        state, reason = state.when(holds, F.col("state") if to is None else F.lit(to)), reason.when(holds, why if isinstance(why, Column) else F.lit(why))
    return rows.withColumn("_state", state).withColumn("reason", reason).withColumn("state", F.col("_state")).drop("_state")


def completed(rows: DataFrame) -> DataFrame:
    """After the client says that the upload is done. Columns said_sha256 and said_size are what it says now, at and expires_at seconds, found the size
    of the stored object (null: none). Reason names what went wrong."""
    waiting = F.col("said_sha256").isNotNull() & F.col("state").isNotNull()
    rules = [
        (F.col("owner") != F.col("by"), None, "attachment_owner_mismatch"),
        (F.col("state") == "clean", None, "already_clean"),
        ((F.col("sha256") != F.col("said_sha256")) | (F.col("byte_size") != F.col("said_size")), "rejected", "checksum_or_size_mismatch"),
        (F.col("expires_at") < F.col("at") - GRACE, "expired", "upload_expired"),
        (F.col("state") == "metadata_only", None, "no_upload_key"),
        (F.col("found").isNull(), None, "object_missing"),
        (F.col("found") != F.col("byte_size"), "rejected", "size_mismatch"),
        (F.lit(True), "quarantine", None),
    ]
    return _step(rows.withColumn("reason", F.lit(None).cast("string")) if "reason" not in rows.columns else rows, rules, waiting)


def detected(data: Column, declared: Column) -> Column:
    """A file's kind by its first bytes; for a declared text, that kind if its first 64 KiB decode; else null."""
    head = F.hex(F.substring(data, 1, 16))
    out = None
    for magic, kind in MAGIC:
        holds = F.startswith(head, F.lit(magic)) & (F.lit(True) if kind != "image/webp" else F.substring(head, 17, 8) == "57454250")
        out = F.when(holds, kind) if out is None else out.when(holds, kind)
    sample = F.substring(data, F.lit(1), F.lit(SAMPLE))
    return out.when(declared.isin(*TEXTUAL) & F.is_valid_utf8(sample.cast("string")), declared)


def finalised(rows: DataFrame) -> DataFrame:
    """After the stored bytes (column data) of what is in quarantine have been read: clean only if size, digest and kind are what was declared, where
    office documents count as one kind. Adds detected."""
    rows = rows.withColumn("detected", F.when(F.col("state") == "quarantine", detected(F.col("data"), F.col("mime"))))
    office = F.col("detected").isin(DOCUMENT, SHEET, SLIDES) & F.col("mime").isin(DOCUMENT, SHEET, SLIDES)
    rules = [
        (F.octet_length("data") != F.col("byte_size"), "rejected", "stored size does not match declared size"),
        (F.sha2("data", 256) != F.col("sha256"), "rejected", "sha256 mismatch between declared and stored bytes"),
        (F.col("detected").isNull(), "rejected", "content does not match any allowed file type"),
        ((F.col("detected") != F.col("mime")) & ~office, "rejected", F.concat(F.lit("declared type "), F.col("mime"), F.lit(" does not match content"))),
        (F.lit(True), "clean", None),
    ]
    return _step(rows, rules, F.coalesce((F.col("state") == "quarantine") & F.col("data").isNotNull(), F.lit(False)))


def expired(rows: DataFrame, now: Column) -> DataFrame:
    """Uploads that were never completed, an hour after their window has ended."""
    late = F.coalesce((F.col("state") == "pending") & (F.col("expires_at") < now - GIVEN_UP), F.lit(False))
    return _step(rows, [(F.lit(True), "expired", "never uploaded before the presigned URL expired")], late)
