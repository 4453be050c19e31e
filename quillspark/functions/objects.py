"""Names of stored objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes by kind of object.
PREFIXES = {
    "raw": "raw/events", "compliance": "raw/compliance", "normalized": "normalized/conversations", "quarantine": "attachments/quarantine", "clean": "attachments/clean", "curated": "attachments/curated",
    "export": "exports/jsonl", "backup": "backups/postgres", "manifest": "backups/manifests",
}


def key_segment(value: Column, longest: int = 200, fallback: str = "unknown") -> Column:
    """A value as one segment of a key: stripped, other characters as underscore, cut, without . _ - at its ends."""
    plain = F.regexp_replace(F.btrim(F.coalesce(value, F.lit("")), F.lit(" \t\n\r\f\u000b")), "[^A-Za-z0-9.:@_-]", "_")
    bare = F.regexp_replace(F.substring(plain, 1, longest), "^[._-]+|[._-]+$", "")
    return F.when(bare == "", F.lit(fallback)).otherwise(bare)


def _dated(kind: str, when: Column, form: str) -> Column:
    return F.concat(F.lit(PREFIXES[kind] + "/"), F.date_format(when, form))


_DAY = "'year='yyyy'/month='MM'/day='dd"


def raw_event_key(workspace: Column, conversation: Column, event: Column, when: Column) -> Column:
    return F.concat(_dated("raw", when, _DAY), F.lit("/workspace="), key_segment(workspace), F.lit("/conversation="), key_segment(conversation), F.lit("/"), key_segment(event), F.lit(".json"))


def compliance_key(workspace: Column, event: Column, when: Column) -> Column:
    return F.concat(_dated("compliance", when, _DAY), F.lit("/workspace="), key_segment(workspace), F.lit("/"), key_segment(event, 180, "event"), F.lit(".json"))


def snapshot_key(workspace: Column, conversation: Column, version: Column, when: Column) -> Column:
    number = F.lpad(version.cast("string"), 6, "0")
    return F.concat(_dated("normalized", when, "'year='yyyy'/month='MM"), F.lit("/workspace="), key_segment(workspace), F.lit("/conversation="), key_segment(conversation), F.lit("/snapshot-"), number, F.lit(".json"))


def attachment_key(stage: str, workspace: Column, conversation: Column, attachment: Column, filename: Column) -> Column:
    """stage: quarantine, clean or curated; filename is a safe one."""
    return F.concat(F.lit(PREFIXES[stage] + "/workspace="), key_segment(workspace), F.lit("/conversation="), key_segment(conversation), F.lit("/"), key_segment(attachment), F.lit("/"), filename)


def part_key(export: Column, part: Column, split: Column) -> Column:
    """A null split leaves its folder out."""
    folder = F.coalesce(F.concat(key_segment(split), F.lit("/")), F.lit(""))
    return F.concat(F.lit(PREFIXES["export"] + "/"), key_segment(export), F.lit("/"), F.when(split.isNull(), F.lit("")).otherwise(folder), F.lit("part-"), F.lpad(part.cast("string"), 5, "0"), F.lit(".jsonl.gz"))


def manifest_key(export: Column) -> Column:
    return F.concat(F.lit(PREFIXES["export"] + "/"), key_segment(export), F.lit("/manifest.json"))


def backup_key(kind: str, name: Column, when: Column) -> Column:
    """kind: backup or manifest."""
    return F.concat(_dated(kind, when, "yyyy/MM/dd/"), name)
