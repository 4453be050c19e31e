"""Document assembly and governed export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import objects as O
from ..functions import text as T
from ..operators import capture as C
from ..operators import identity as I
from ..operators.numbering import numbered
from ..sources.sinks import part_files
from ..sources.tables import table
from ..streaming.events import scratch
from .registry import query
from .sql import BUCKET, LOG

RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}
PART_ROWS = 5000
_B = BUCKET.format("cast(conv_id as varchar)")
_SPLIT = f"case when {_B} / 4294967295 < 0.1 then 'test' when {_B} / 4294967295 < 0.9 then 'train' else 'validation' end"


def pairs(turns: DataFrame) -> DataFrame:
    """Adjacent turns user -> assistant, by position in the list of turns."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    following = turns.withColumns({"next_role": F.lead("role").over(by), "next_turn": F.lead("turn").over(by), "answer": F.lead("text").over(by)})
    return following.where("role = 'user' and next_role = 'assistant'")


@query("""select conv_id, turn, next_turn, sha256(text) as prompt_sha256, sha256(answer) as answer_sha256 from (
  select *, lead(role) over w as next_role, lead(turn) over w as next_turn, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn))
  where role = 'user' and next_role = 'assistant'""")
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(table(spark, sf_dir, "conversations"))
    return p.select("conv_id", "turn", "next_turn", F.sha2("text", 256).alias("prompt_sha256"), F.sha2("answer", 256).alias("answer_sha256"))


@query("""select doc_id, lang, source, n_chars from documents where lang in ('en', 'de', 'fr', 'es') and n_chars >= 10
  and doc_id in (select doc_id from labels where quality = 1 and toxic = 0)""")
def export_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved and free of secrets, as a semi-join; filters apply before it."""
    approved = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de", "fr", "es") & (F.col("n_chars") >= 10))
    return docs.join(approved, "doc_id", "left_semi").select("doc_id", "lang", "source", "n_chars")


def split_of(turns: DataFrame) -> DataFrame:
    """One row a conversation: a whole conversation always falls into one split."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return sizes.withColumn("split", T.split_name(F.col("conv_id").cast("string"), RATIOS))


@query(f"select conv_id, count(*) as turns, {_SPLIT} as split from conversations group by conv_id")
def export_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_of(table(spark, sf_dir, "conversations")).select("conv_id", "turns", "split")


_RECORD = """'{"conversation":' || conv_id || ',"turns":[' || string_agg('"' || role || ':' || sha256(text) || '"', ',' order by turn) || ']}'"""


@query(f"select conv_id, count(*) as turns, cast(sum(length(text)) as bigint) as chars, sha256({_RECORD}) as record_sha256, {_SPLIT} as split from conversations group by conv_id")
def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record a conversation; its digest is taken before the split is added."""
    turn = F.struct("turn", F.concat("role", F.lit(":"), F.sha2("text", 256)).alias("entry"))
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.array_sort(F.collect_list(turn)).alias("list"))
    record = F.to_json(F.struct(F.col("conv_id").alias("conversation"), F.transform("list", lambda x: x["entry"]).alias("turns")))
    return own.select("conv_id", "turns", "chars", F.sha2(record, 256).alias("record_sha256"), T.split_name(F.col("conv_id").cast("string"), RATIOS).alias("split"))


@query(f"""with s as (select conv_id, {_SPLIT} as split, count(*) as turns from conversations group by conv_id),
 n as (select *, (row_number() over (partition by split order by conv_id) - 1) // 200 as chunk from s),
 p as (select split, chunk, count(*) as conversations, cast(sum(turns) as bigint) as records, min(conv_id) as first_conversation from n group by all)
 select split, cast(row_number() over (order by split, chunk) - 1 as int) as part, conversations, records, first_conversation from p""")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of 200 conversations within each split, numbered over all splits: only the parts' totals meet in one window."""
    own = numbered(split_of(table(spark, sf_dir, "conversations")), "split", "conv_id")
    parts = own.withColumn("chunk", F.floor(F.col("number") / 200)).groupBy("split", "chunk").agg(F.count("*").alias("conversations"), F.sum("turns").alias("records"), F.min("conv_id").alias("first_conversation"))
    number = (F.row_number().over(Window.orderBy("split", "chunk")) - 1).cast("int")
    return parts.select("split", number.alias("part"), "conversations", "records", "first_conversation")


@query(f"""with {LOG} select conv_id, count(distinct turn) as messages, count(*) as versions, sha256(string_agg(turn || ':' || version_number || ':' || digest, ',' order by turn, version_number)) as document_sha256 from versions group by conv_id""")
def snapshot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions nested in messages nested in conversations, with a digest of the whole document."""
    d = snapshots(spark, sf_dir)
    flat = F.flatten(F.transform("messages", lambda m: F.transform(m["versions"], lambda v: F.concat(m["turn"].cast("string"), F.lit(":"), v["version_number"].cast("string"), F.lit(":"), v["digest"]))))
    return d.select("conv_id", F.size("messages").cast("long").alias("messages"), F.size(flat).cast("long").alias("versions"), F.sha2(F.array_join(flat, ","), 256).alias("document_sha256"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = I.versions(C.admitted(C.capture_log(spark, sf_dir)))
    message = v.groupBy("conv_id", "turn", "role").agg(F.array_sort(F.collect_list(F.struct("version_number", "digest", "first_arrival"))).alias("versions"))
    return message.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "versions"))).alias("messages"))


def curated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a conversation, with its current turns, pairs and digest, before it is split. The digest is of the record's
    JSON with sorted keys."""
    current = I.current(I.versions(C.admitted(C.capture_log(spark, sf_dir))))
    turn = F.struct(F.col("current_digest").alias("content_sha256"), "role", F.col("turn").alias("sequence_index"))
    own = current.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("at"), turn.alias("entry")))).alias("list"))
    messages = F.transform("list", lambda x: x["entry"])
    following = F.zip_with(F.slice("messages", F.lit(1), F.greatest(F.size("messages") - 1, F.lit(0))), F.slice("messages", F.lit(2), F.greatest(F.size("messages") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    answered = F.filter(following, lambda x: (x["a"]["role"] == "user") & (x["b"]["role"] == "assistant"))
    pairs_of = F.transform(answered, lambda x: F.struct(x["b"]["content_sha256"].alias("answer"), x["a"]["content_sha256"].alias("prompt")))
    record = F.struct(F.col("conv_id").alias("conversation_id"), F.size("messages").alias("message_count"), "messages", "pairs")
    return own.withColumn("messages", messages).withColumn("pairs", pairs_of).withColumn("record_sha256", F.sha2(F.to_json(record), 256)).drop("list")


_CURATED = f"""{LOG}, cur as (select conv_id, turn, role, digest from versions qualify row_number() over (partition by conv_id, turn order by version_number desc) = 1),
 nx as (select *, lead(role) over w as next_role, lead(digest) over w as answer from cur window w as (partition by conv_id order by turn)),
 rec as (select conv_id, count(*) as message_count, count(*) filter (role = 'user' and next_role = 'assistant') as pairs,
  sha256('{{"conversation_id":' || conv_id || ',"message_count":' || count(*) || ',"messages":[' || string_agg('{{"content_sha256":"' || digest || '","role":"' || role || '","sequence_index":' || turn || '}}', ',' order by turn)
  || '],"pairs":[' || coalesce(string_agg('{{"answer":"' || answer || '","prompt":"' || digest || '"}}', ',' order by turn) filter (role = 'user' and next_role = 'assistant'), '') || ']}}') as record_sha256, {_SPLIT} as split from nx group by conv_id)"""


@query(f"with {_CURATED} select * from rec")
def curated_export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = curated_records(spark, sf_dir)
    return r.select("conv_id", F.size("messages").cast("long").alias("message_count"), F.size("pairs").cast("long").alias("pairs"), "record_sha256", T.split_name(F.col("conv_id").cast("string"), RATIOS).alias("split"))


@query(f"""with {_CURATED}, n as (select *, (row_number() over (partition by split order by conv_id) - 1) // {PART_ROWS} as chunk from rec),
 p as (select split, chunk, count(*) as records, sha256(string_agg(record_sha256, ',' order by conv_id)) as content from n group by all)
 select split, 'exports/jsonl/e1/' || split || '/part-' || lpad(cast(row_number() over (order by split, chunk) as varchar), 5, '0') || '.jsonl.gz' as object_key, records, true as verified, content from p""")
def export_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as parts of at most PART_ROWS of one split, with bytes and digest in a manifest, and read back by it: verified
    tells whether a file's bytes are those that the manifest names, content is the digest of its records' digests."""
    folder = scratch(spark)
    split = T.split_name(F.col("conv_id").cast("string"), RATIOS)
    rows = numbered(curated_records(spark, sf_dir).withColumn("split", split), "split", "conv_id").withColumn("chunk", F.floor(F.col("number") / PART_ROWS))
    part_files(rows, f"{folder}/parts", ["conv_id", "messages", "pairs", "record_sha256", "split"], ["split", "chunk"], "conv_id").write.parquet(f"{folder}/manifest")
    manifest = spark.read.parquet(f"{folder}/manifest")
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    stored = spark.read.format("binaryFile").load(f"{folder}/parts").select(name, F.col("length").alias("found"), F.sha2("content", 256).alias("digest"))
    lines = spark.read.schema("conv_id long, record_sha256 string").json(f"{folder}/parts").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "conv_id", "record_sha256")
    back = lines.groupBy("file").agg(F.count("*").alias("read"), F.array_sort(F.collect_list(F.struct("conv_id", "record_sha256"))).alias("own"))
    whole = manifest.join(stored, "file").join(back, "file")
    number = F.row_number().over(Window.orderBy("split", "chunk"))  # a row for each part
    verified = (F.col("bytes") == F.col("found")) & (F.col("sha256") == F.col("digest")) & (F.col("records") == F.col("read"))
    content = F.sha2(F.array_join(F.transform("own", lambda x: x["record_sha256"]), ","), 256)
    return whole.select("split", O.part_key(F.lit("e1"), number, F.col("split")).alias("object_key"), "records", verified.alias("verified"), content.alias("content"))
