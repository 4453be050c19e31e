"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality as quality_rules
from . import resampling
from . import topk as top_k_search
from . import vector_codes as codes
from .bpe_codec import codec_digests
from .common import table
from .lm import lm_scores
from .main_text import main_text
from .packing import packed
from .quality import quality
from .resampling import resampled
from .secret_scan import secret_scan
from .simhash import near_duplicates
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .token_files import file_digests
from .topk import top_k
from .vector_codes import vector_codes


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_digests(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_top_k": op2_top_k,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_counts": op7_token_counts,
    "op8_token_files": op8_token_files,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_main_text": op11_main_text,
    "op12_vector_codes": op12_vector_codes,
    "op13_resampling": op13_resampling,
}

ORACLE: dict[str, str] = {
    "op2_top_k": top_k_search.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op12_vector_codes": codes.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
