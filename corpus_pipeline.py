"""The corpus pipeline: documents through quality rules, near and exact deduplication, secret scans and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import stored, table
from quillspark.llm.packing import packed
from quillspark.llm.quality import kept_documents
from quillspark.llm.secret_scan import redacted
from quillspark.llm.similar import one_of_similar
from quillspark.llm.suffix_dedup import without_passages


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the cascade go."""
    return kept_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts at 5-word similarity of 0.8 or more, as SimHash fingerprints and bands propose and an exact check
    confirms, the document with the smallest id stays."""
    return one_of_similar(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 51 words that occur twice go from the texts; all documents stay."""
    return without_passages(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; all documents stay."""
    return redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no XXH64, tokenizer or connected components over any number of links: tests compare run() with a pipeline in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs)
    return docs
