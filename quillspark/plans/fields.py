"""Scalar functions over fields made from events, pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import objects as O
from ..functions import records as R
from ..functions import text as T
from ..sources.tables import instant, table
from .operations import _E
from .registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


_WHEN = f"case event_id % 5 when 0 then cast({_E} as varchar) when 1 then cast({_E} * 1000 as varchar) when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 3 then strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') else 'not a time' end"


@query(f"select event_id, {_WHEN} as given, case when event_id % 5 < 4 then {_E} else -1 end as at from events")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as seconds, milliseconds and ISO texts; what is none gives -1."""
    at = F.unix_seconds(instant("ts"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    form = F.col("event_id") % 5
    given = F.when(form == 0, at.cast("string")).when(form == 1, (at * 1000).cast("string")).when(form == 2, F.concat(iso, F.lit("Z"))).when(form == 3, F.concat(iso, F.lit("+00:00"))).otherwise("not a time")
    e = _events(spark, sf_dir).select("event_id", given.alias("given"))
    return e.select("event_id", "given", F.coalesce(F.unix_seconds(R.parsed_time(F.col("given"))), F.lit(-1)).alias("at"))


_ID = "lpad(cast(event_id as varchar), 8, '0')"


@query(f"select event_id, case when event_id % 4 < 3 then {_ID} end as conversation from events")
def url_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation that a page's address names, in any of its places."""
    own = F.lpad(F.col("event_id").cast("string"), 8, "0")
    place = F.col("event_id") % 4
    url = F.when(place == 0, F.concat(F.lit("https://e.org/c/"), own)).when(place == 1, F.concat(F.lit("https://e.org/share/"), own, F.lit("?x=1"))).when(place == 2, F.concat(F.lit("https://e.org/?a=b&conversation="), own)).otherwise("https://e.org/settings")
    return _events(spark, sf_dir).select("event_id", R.conversation_of(url).alias("conversation"))


@query("""with v as (select *, event_id % 7 as a, event_id % 13 as b, event_id % 3 as c from events) select event_type, max((a * 100 + b) * 10 + c) as newest, count(*) filter (a > 1 or (a = 1 and b > 4) or (a = 1 and b = 4 and c >= 2)) as supported from v group by event_type""")
def client_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions compared by number, not by letter: the newest, and how many reach 1.4.2."""
    e = _events(spark, sf_dir).select("event_type", R.version_key(F.expr("concat_ws('.', event_id % 7, event_id % 13, event_id % 3)")).alias("key"))
    newest = F.max("key")
    return e.groupBy("event_type").agg(((newest[0] * 100 + newest[1]) * 10 + newest[2]).cast("long").alias("newest"), F.count_if(F.col("key") >= R.version_key(F.lit("1.4.2"))).alias("supported"))


@query("""select event_id, 'kind=' || event_type || ',user=' || user_id as details, 'kind=' || event_type || ',note=new,user=0' as patched, 'kind=' || event_type || ',text=[CONTENT_SUPPRESSED],token=[REDACTED],user=' || user_id as logged from events""")
def audit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of an audit row, fields with a patch on them, and fields as a log shows them."""

    def listed(fields: Column) -> Column:
        return F.array_join(F.array_sort(F.transform(F.map_entries(fields), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",")

    fields = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("text"), F.lit("said"), F.lit("token"), F.lit("abc"))
    e = _events(spark, sf_dir).select("event_id", fields.alias("fields"))
    kept = F.map_filter(R.audit_details(F.col("fields")), lambda k, v: ~F.lower(k).isin(*R.SENSITIVE_KEYS))  # without credentials, too
    patched = R.merged(kept, F.create_map(F.lit("user"), F.lit("0"), F.lit("note"), F.lit("new")))
    return e.select("event_id", listed(kept).alias("details"), listed(patched).alias("patched"), listed(R.scrubbed_map(F.col("fields"))).alias("logged"))


_LINE = "'GET Authorization: bEaReR tok-' || event_id || '== AKIA' || lpad(cast(event_id as varchar), 16, '0') || ' /o?X-Amz-Signature=ab' || event_id || '&x-amz-credential=me/' || user_id || ' eyJhbGciOiJI.eyJzdWIiOiIx.' || lpad(cast(event_id as varchar), 10, 'x') || ' ' || event_type"


@query(f"""select event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_LINE}, '(?i)bearer\\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g'), '(?i)\\bAKIA[0-9A-Z]{{16}}\\b', '[REDACTED_AWS_KEY]', 'g'),
 '(?i)(X-Amz-Signature=)[0-9a-f]+', '\\1[REDACTED]', 'g'), '(?i)(X-Amz-Credential=)[^&\\s]+', '\\1[REDACTED]', 'g'), 'eyJ[A-Za-z0-9_-]{{8,}}\\.[A-Za-z0-9_-]{{8,}}\\.[A-Za-z0-9_-]{{8,}}', '[REDACTED_JWT]', 'g') as line from events""")
def scrubbed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines without credentials."""
    own = F.col("event_id").cast("string")
    line = F.concat(
        F.lit("GET Authorization: bEaReR tok-"), own, F.lit("== AKIA"), F.lpad(own, 16, "0"), F.lit(" /o?X-Amz-Signature=ab"), own, F.lit("&x-amz-credential=me/"), F.col("user_id").cast("string"),
        F.lit(" eyJhbGciOiJI.eyJzdWIiOiIx."), F.lpad(own, 10, "x"), F.lit(" "), "event_type",
    )
    return _events(spark, sf_dir).select("event_id", T.scrubbed(line).alias("line"))


@query("""select event_id, case event_id % 5 when 0 then '10.0.' || event_id % 256 || '.' || user_id % 256 when 1 then '10.0.' || event_id % 256 || '.' || user_id % 256 when 2 then '2001:db8::' || printf('%x', event_id % 65535 + 1) end as address from events""")
def client_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in their shortest form: plain, mapped into the longer kind, written out, and none at all."""
    four = F.expr("concat('10.0.', event_id % 256, '.', user_id % 256)")
    form = F.col("event_id") % 5
    given = F.when(form == 0, F.concat(F.lit(" "), four)).when(form == 1, F.concat(F.lit("::ffff:"), four)).when(form == 2, F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), F.hex(F.col("event_id") % 65535 + 1))).when(form == 3, F.lit("10.0.0.999"))
    return _events(spark, sf_dir).select("event_id", R.canonical_address(given).alias("address"))


_SECRET = b"archive"
_INNER, _OUTER = (bytes(x ^ pad for x in _SECRET.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query(f"""with m as (select event_id, user_id || '|' || event_type as message from events),
 s as (select event_id, rtrim(replace(replace(base64(unhex(sha256(unhex('{_OUTER}' || sha256(unhex('{_INNER}' || hex(encode(message)))))))), '+', '-'), '/', '_'), '=') as signature from m)
 select event_id, signature, event_id % 3 <> 0 as verified from s""")
def signed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed signatures, and whether those given (a third of them altered) are right."""
    message = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    e = _events(spark, sf_dir).select("event_id", R.signature(_SECRET.decode())(message).alias("signature"))
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "signature")).otherwise(F.col("signature"))
    return e.select("event_id", "signature", (given == F.col("signature")).alias("verified"))


#: Small files by kind of event: (content in hexadecimal, name).
FILES = {
    "signup": ("89504E470D0A1A0A00000004744558744100626300000000", "a.PNG"), "purchase": ("FFD8FFE000046162FFE100084578696600 00FFDA0002".replace(" ", ""), "photo.jpeg"), "error": ("255044462D312E37", "x.pdf"),
    "view": ("706C61696E20C3A9", "note.txt"), "click": ("0001FF", "note.txt"),
}
_HEX = "case event_type " + " ".join(f"when '{k}' then '{h}'" for k, (h, _) in FILES.items()) + " end"
_NAME = "case event_type " + " ".join(f"when '{k}' then '{n}'" for k, (_, n) in FILES.items()) + " end"


@query(f"""select event_id, case event_type when 'signup' then 'image/png' when 'purchase' then 'image/jpeg' when 'error' then 'application/pdf' when 'view' then 'text/plain' else 'application/octet-stream' end as kind, event_type <> 'click' as fits,
 case event_type when 'signup' then '89504E470D0A1A0A' when 'purchase' then 'FFD8FFE000046162FFDA0002' else {_HEX} end as clean from events""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file is by its bytes, whether its name says so, and its bytes without metadata."""
    e = _events(spark, sf_dir).select("event_id", F.unhex(F.expr(_HEX)).alias("data"), F.expr(_NAME).alias("name"))
    e = e.withColumn("kind", B.sniffed(F.col("data")))
    return e.select("event_id", "kind", B.fits(F.col("name"), F.col("kind")).alias("fits"), F.hex(B.without_metadata(F.col("data"))).alias("clean"))


_SEGMENT = "regexp_replace(substr(regexp_replace(trim({0}), '[^A-Za-z0-9.:@_-]', '_', 'g'), 1, {1}), '^[._-]+|[._-]+$', '', 'g')"


@query(f"select page_id, {_SEGMENT.format('url', 200)} as segment, coalesce(nullif({_SEGMENT.format(chr(39) + '._ ' + chr(39) + ' || substr(url, 1, cast(page_id % 3 as int))', 180)}, ''), 'event') as short from pages")
def key_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    odd = F.concat(F.lit("._ "), F.expr("substring(url, 1, cast(page_id % 3 as int))"))
    return p.select("page_id", O.key_segment(F.col("url")).alias("segment"), O.key_segment(odd, 180, "event").alias("short"))


_DAY = "strftime(ts, 'year=%Y/month=%m/day=%d')"


@query(f"""select event_id, 'raw/events/' || {_DAY} || '/workspace=w' || user_id || '/conversation=c_' || user_id || '/e' || event_id || '.json' as raw, 'raw/compliance/' || {_DAY} || '/workspace=w' || user_id || '/e' || event_id || '.json' as compliance,
 'normalized/conversations/' || strftime(ts, 'year=%Y/month=%m') || '/workspace=w' || user_id || '/conversation=c_' || user_id || '/snapshot-' || lpad(cast(event_id % 1000 as varchar), 6, '0') || '.json' as snapshot,
 'attachments/' || case event_id % 3 when 0 then 'quarantine' when 1 then 'clean' else 'curated' end || '/workspace=w' || user_id || '/conversation=c_' || user_id || '/e' || event_id || '/a_b.png' as attachment,
 'exports/jsonl/e' || event_id || '/' || case when event_id % 2 = 0 then 'train/' else '' end || 'part-00007.jsonl.gz' as part, 'exports/jsonl/e' || event_id || '/manifest.json' as manifest,
 'backups/postgres/' || strftime(ts, '%Y/%m/%d') || '/db.dump' as backup, 'backups/manifests/' || strftime(ts, '%Y/%m/%d') || '/db.json' as backup_manifest from events""")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of a stored object's key."""
    e = _events(spark, sf_dir)
    user, when, event = F.col("user_id").cast("string"), F.col("ts"), F.concat(F.lit("e"), F.col("event_id").cast("string"))
    workspace, conversation, name = F.concat(F.lit(" w"), user), F.concat(F.lit("c/"), user), T.safe_filename(F.lit("a b.PNG"))
    stages = {s: O.attachment_key(s, workspace, conversation, event, name) for s in ("quarantine", "clean", "curated")}
    place = F.col("event_id") % 3
    return e.select(
        "event_id", O.raw_event_key(workspace, conversation, event, when).alias("raw"), O.compliance_key(workspace, event, when).alias("compliance"), O.snapshot_key(workspace, conversation, F.col("event_id") % 1000, when).alias("snapshot"),
        F.when(place == 0, stages["quarantine"]).when(place == 1, stages["clean"]).otherwise(stages["curated"]).alias("attachment"),
        O.part_key(event, F.lit(7), F.when(F.col("event_id") % 2 == 0, F.lit("train"))).alias("part"), O.manifest_key(event).alias("manifest"), O.backup_key("backup", F.lit("db.dump"), when).alias("backup"), O.backup_key("manifest", F.lit("db.json"), when).alias("backup_manifest"),
    )


@query(r"""select page_id, cast(len(regexp_extract_all(html, '<a[\s>]')) as bigint) as links, cast(len(regexp_extract_all(html, '<li[\s>]')) as bigint) as items, cast(len(regexp_extract_all(html, '<script[\s>]')) as bigint) as scripts, contains(html, '<main') as has_main, cast(len(html) as bigint) as chars from pages""")
def page_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that tell whether a page still has the structure that its reader expects."""
    found = lambda tag: F.regexp_count("html", F.lit(rf"<{tag}[\s>]")).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", found("a").alias("links"), found("li").alias("items"), found("script").alias("scripts"), F.contains("html", F.lit("<main")).alias("has_main"), F.length("html").cast("long").alias("chars"))


