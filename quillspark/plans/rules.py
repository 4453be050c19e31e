"""Decisions by ordered rules: workspaces, attachments, what audit rows and logs may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import attachments as A
from ..operators import policy as P
from ..sources.tables import table
from .registry import query

#: A customer as a workspace that a client describes, and the settings that it meets: in SQL that both engines read.
_WORKSPACE = {
    "kill_switch": "c_custkey % 37 = 0", "capture_enabled": "case when c_custkey % 31 = 0 then null else c_custkey % 29 <> 0 end", "authorized": "c_custkey % 23 <> 0", "attachments_enabled": "c_custkey % 5 <> 0",
    "kind": "case when c_mktsegment = 'HOUSEHOLD' then 'personal' when c_custkey % 19 = 0 then 'shared' when c_custkey % 17 <> 0 then 'managed_company' end", "verified": "c_custkey % 13 <> 0",
    "workspace_id": "case c_custkey % 4 when 0 then ' ws-1 ' when 1 then 'ws-2' when 2 then '' end", "label": "case when c_custkey % 3 = 0 then ' ACME Inc ' else c_name end", "allowed_label": "case when c_nationkey % 3 = 0 then 'acme INC' when c_nationkey % 3 = 1 then ' ' end",
}
_LISTED, _SEEN = "c_nationkey % 2 = 0", "c_custkey % 7 in (1, 2, 5)"


@query(
    f"""with w as (select c_custkey, {', '.join(f'{e} as {c}' for c, e in _WORKSPACE.items())}, {_LISTED} as listed, {_SEEN} as strong from customer)
 select c_custkey, case when kill_switch then 'kill_switch_active' when not coalesce(capture_enabled, false) then 'capture_disabled' when not authorized then 'authorization_not_confirmed' when not attachments_enabled then 'attachments_disabled' else 'open' end as gate,
 case when kind = 'personal' then 'personal_workspace_blocked' when kind is null or kind <> 'managed_company' or not verified then 'workspace_unverified' when not listed and trim(coalesce(allowed_label, '')) = '' then 'workspace_policy_unconfigured'
  when listed then case when coalesce(trim(workspace_id), '') not in ('ws-1', 'ws-9') then 'workspace_not_allowlisted' when not strong then 'workspace_signal_missing' else 'workspace_id_allowlisted' end
  else case when lower(trim(label)) <> lower(trim(allowed_label)) then 'workspace_label_mismatch' when not strong then 'workspace_signal_missing' else 'workspace_label_matched' end end as reason from w"""
)
def workspace_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each workspace's reason, and the gate that holds for its attachments."""
    c = table(spark, sf_dir, "customer").select("c_custkey", *(F.expr(e).alias(n) for n, e in _WORKSPACE.items()), F.expr(_LISTED).alias("listed"), F.expr(_SEEN).alias("strong"))
    allowed = F.when(F.col("listed"), F.array(F.lit(" ws-1"), F.lit("ws-9"), F.lit(" ")))
    signals = F.when(F.col("strong"), F.array(F.lit("odd"), F.lit("workspace_id_match"))).when(F.col("c_custkey") % 2 == 0, F.array(F.lit("enterprise_workspace_marker")))
    w = c.withColumns({"allowed_ids": allowed, "signals": signals})
    return w.select("c_custkey", F.coalesce(P.capture_gate(attachments=True), F.lit("open")).alias("gate"), P.workspace_reason().alias("reason"))


#: Documents as attachments: kinds that are declared, with a name and the first bytes that are stored.
_KINDS = [
    ("image/png", "a b.PNG", "89504E470D0A1A0A"), ("image/webp", "c.webp", "524946460000000057454250"), ("text/plain", "d.log", ""), ("application/pdf", "e.pdf", "255044462D"), ("application/x-sh", "f.sh", ""), (A.SHEET, "g.xlsx", "504B0304"),
    ("image/webp", "h.webp", "5249464600000000"), ("image/gif", "i.png", "474946383961"), ("application/json", "j.json", "FF"), ("image/jpeg", "k.jpg", "474946383761"), ("text/csv", "l.csv", ""),
]
_MOST, _NOW, _OPEN = 12_000, 100_000, 3600
_PICK = lambda k: f"element_at(array({', '.join(repr(x[k]) for x in _KINDS)}), cast(doc_id % {len(_KINDS)} + 1 as int))"
_PICK_SQL = lambda k: f"[{', '.join(repr(x[k]) for x in _KINDS)}][doc_id % {len(_KINDS)} + 1]"
_FACTS = {
    "metadata_only": "doc_id % 53 = 0", "before": "case when doc_id % 47 = 0 then 'clean' when doc_id % 43 = 0 then 'rejected' end", "owner": "'o'", "by": "case when doc_id % 41 = 0 then 'x' else 'o' end", "said": "doc_id % 37 <> 0",
    "expires_at": f"{_NOW} - doc_id % 4 * 4000 + {_OPEN}", "at": f"{_NOW} - doc_id % 3 * 2000", "odd_now": "doc_id % 31 = 0", "lost": "doc_id % 29 = 0", "larger": "doc_id % 23 = 0", "other": "doc_id % 19 = 0", "longer": "doc_id % 17 = 0",
}
_IS = lambda h: f"starts_with(head, '{h}')"


@query(
    f"""with f as (select doc_id, {_PICK_SQL(0)} as mime, {_PICK_SQL(1)} as filename, unhex({_PICK_SQL(2)}) || encode(coalesce(text, '')) as stored, {', '.join(f'{e} as "{c}"' for c, e in _FACTS.items())} from documents),
 d as (select *, octet_length(stored) as byte_size, hex(stored)[1:32] as head, coalesce("before" = 'clean', false) as done, case when octet_length(stored) > {_MOST} then 'attachment_too_large' when mime = 'application/x-sh' then 'mime_type_not_allowed' when filename = 'i.png' then 'extension_mismatch' end as refused from f),
 a as (select *, case when refused is not null or done then "before" when metadata_only then 'metadata_only' else 'pending' end as s0 from d),
 c as (select *, case when s0 is null or not said or "by" <> 'o' or s0 = 'clean' then s0 when odd_now then 'rejected' when expires_at < "at" - 900 then 'expired' when s0 = 'metadata_only' or lost then s0 when larger then 'rejected' else 'quarantine' end as s1,
  case when s0 is null or not said then '' when "by" <> 'o' then 'attachment_owner_mismatch' when s0 = 'clean' then 'already_clean' when odd_now then 'checksum_or_size_mismatch' when expires_at < "at" - 900 then 'upload_expired' when s0 = 'metadata_only' then 'no_upload_key' when lost then 'object_missing'
   when larger then 'size_mismatch' else '' end as r1 from a),
 k as (select *, case when other then null when {_IS('89504E470D0A1A0A')} then 'image/png' when {_IS('FFD8FF')} then 'image/jpeg' when {_IS('474946383761')} or {_IS('474946383961')} then 'image/gif' when {_IS('52494646')} and head[17:24] = '57454250' then 'image/webp'
   when {_IS('255044462D')} then 'application/pdf' when {_IS('504B0304')} then '{A.DOCUMENT}' when mime in ('text/plain', 'text/csv') then mime end as kind from c),
 z as (select *, case when s1 is distinct from 'quarantine' then s1 when longer then 'rejected' when other then 'rejected' when kind is null then 'rejected' when kind <> mime and mime <> '{A.SHEET}' then 'rejected' else 'clean' end as s2,
  case when s1 is distinct from 'quarantine' then r1 when longer then 'stored size does not match declared size' when other then 'sha256 mismatch between declared and stored bytes' when kind is null then 'content does not match any allowed file type'
   when kind <> mime and mime <> '{A.SHEET}' then 'declared type ' || mime || ' does not match content' else '' end as r2 from k)
 select doc_id, coalesce(refused, '') as refused, refused is null and done as duplicate, coalesce(s0, 'none') as announced, coalesce(s1, 'none') as completed, case when s2 = 'pending' and expires_at < {_NOW} + 0 - 3600 then 'expired' else coalesce(s2, 'none') end as state,
  case when s2 = 'pending' and expires_at < {_NOW} + 0 - 3600 then 'never uploaded before the presigned URL expired' else r2 end as reason from z"""
)
def attachment_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transitions of documents as attachments, with whatever can go wrong on the way."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(_PICK(0)).alias("mime"), F.expr(_PICK(1)).alias("filename"), F.concat(F.unhex(F.expr(_PICK(2))), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("stored"), *(F.expr(e).alias(c) for c, e in _FACTS.items())
    )
    size = F.octet_length("stored")
    d = d.withColumns({"byte_size": size, "sha256": F.sha2("stored", 256), "found": F.when(~F.col("lost"), size + F.col("larger").cast("int"))})
    d = d.withColumns({"said_sha256": F.when(F.col("said"), F.col("sha256")), "said_size": size + F.col("odd_now").cast("int")})
    other = F.concat(F.lit(b"\xfe"), F.substring("stored", F.lit(2), size))  # as long, with another first byte
    d = d.withColumn("data", F.when(F.col("longer"), F.concat("stored", F.lit(b"x"))).when(F.col("other") & (size > 0), other).otherwise(F.col("stored")))
    announced = A.announced(d, _MOST).withColumn("announced", F.col("state"))
    completed = A.completed(announced).withColumn("completed", F.col("state"))
    out = A.expired(A.finalised(completed), F.lit(_NOW))
    named = {c: F.coalesce(c, F.lit("none")) for c in ("announced", "completed", "state")}
    return out.select("doc_id", F.coalesce("refused", F.lit("")).alias("refused"), "duplicate", *(x.alias(c) for c, x in named.items()), F.coalesce("reason", F.lit("")).alias("reason"))


_ENTRY = "concat('{{\"user\":', user_id, ',\"Note\":\"n\",\"list\":[{{\"Token\":\"t', event_id, '\",\"Body\":\"b\"}},\"bearer a', event_id, '\"],\"a\":{{\"b\":{{\"c\":{{\"d\":{{\"e\":{{\"f\":{{\"g\":1}}}}}}}}}}}},\"title\":\"', event_type, '\"}}')".format()
_SHOWN = "concat('{{\"Note\":\"n\",\"a\":{{\"b\":{{\"c\":{{\"d\":{{\"e\":{{\"f\":{{\"g\":\"[TRUNCATED]\"}}}}}}}}}}}},\"list\":[{{\"Body\":\"[CONTENT_SUPPRESSED]\",\"Token\":\"[REDACTED]\"}},\"Bearer [REDACTED]\"],\"title\":\"[CONTENT_SUPPRESSED]\",\"user\":', user_id, '}}')".format()


@query(f"select event_id, 'kind=' || event_type || ',token=abc,user=' || user_id as details, {_SHOWN} as logged from events")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details without content, and nested log entries without content and credentials on any level."""
    fields = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("token"), F.lit("abc"), F.lit("Text"), F.lit("said"), F.lit("note"), F.lit("n"), F.lit("Sanitized_HTML"), F.lit("<p>"))
    details = F.array_join(F.array_sort(F.transform(F.map_entries(R.audit_details(fields)), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",")
    return table(spark, sf_dir, "events").select("event_id", details.alias("details"), R.scrubbed_entry(F.expr(_ENTRY)).alias("logged"))


_EXTENSIONS = ", ".join(f"({k}, '{x}')" for k, own in enumerate(A.ALLOWED.values()) for x in own)


@query(f"with x(k, e) as (values {_EXTENSIONS}), u as (select distinct lang, (doc_id * 7 + n_chars) % {len(A.ALLOWED) + 3} as k from documents) select lang, string_agg(distinct e, ',' order by e) as extensions from u join x using (k) group by lang")
def declared_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language's attachments, which extensions their declared kinds allow; kinds that aren't allowed have none."""
    own = F.array(*(F.array(*map(F.lit, x)) for x in A.ALLOWED.values()))
    used = table(spark, sf_dir, "documents").select("lang", ((F.col("doc_id") * 7 + F.col("n_chars")) % (len(A.ALLOWED) + 3)).alias("k")).distinct()  # a few rows a language
    lists = used.groupBy("lang").agg(F.collect_list(F.get(own, F.col("k").cast("int"))).alias("x"))
    found = lists.withColumn("e", F.array_sort(F.array_distinct(F.flatten("x")))).where(F.size("e") > 0)
    return found.select("lang", F.array_join("e", ",").alias("extensions"))


#: Seconds for which a fetched configuration is used.
TTL = 15 * 60


@query(f"""with c as (select event_id, {_NOW} + event_id % 50 - 25 as expires_at, case when event_id % 7 <> 0 then {_NOW} - event_id % 40 * 60 end as fetched_at, event_id % 11 = 0 as missing, event_id % 13 = 0 as unreadable from events)
 select event_id, missing or unreadable or expires_at <= {_NOW} or coalesce(fetched_at, 0) + {TTL} < {_NOW} as stale, case when missing then 'none' else 'cache' end as source from c""")
def config_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cached configuration may still be used: it is neither expired, nor fetched too long ago, nor without a time that can be read."""
    at = F.timestamp_seconds(F.lit(_NOW) + F.col("event_id") % 50 - 25)
    expires = F.when(F.col("event_id") % 13 == 0, "soon").otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    c = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, expires).alias("expires_at"), F.when(F.col("event_id") % 7 != 0, F.lit(_NOW) - F.col("event_id") % 40 * 60).alias("fetched_at"))
    gone = F.coalesce(F.unix_seconds(R.parsed_time(F.col("expires_at"))) <= _NOW, F.lit(True))
    old = F.coalesce("fetched_at", F.lit(0)) + TTL < _NOW
    return c.select("event_id", (F.col("expires_at").isNull() | gone | old).alias("stale"), F.when(F.col("expires_at").isNull(), "none").otherwise("cache").alias("source"))
