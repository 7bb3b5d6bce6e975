"""Queries ``opN_<name>`` over the driver's tables; :mod:`.oracles` has the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact import exact_duplicates
from .licenses import TRIGGERS, document_path, scan_licenses
from .media import media_columns
from .minhash import MinHashParams, near_duplicates
from .mixing import mix_sources
from .oracles import ORACLES
from .quality import quality_scores
from .substrings import SubstringParams, remove_repeats
from .tokens import count_tokens, encode_decode
from .urls import filter_urls


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that names a licence counts as a licence file of its directory."""
    named = F.coalesce(F.col("text").rlike(TRIGGERS), F.lit(False))
    return scan_licenses(table(spark, sf_dir, "documents"), path=document_path(), licence_file=named)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte ranges of the key frames as text, ``first-end`` joined by commas."""
    shown = F.array_join(F.transform("key_ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return media_columns(table(spark, sf_dir, "documents")).withColumn("key_ranges", shown)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), MinHashParams(shingle=3, percent=85))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), SubstringParams(window=35))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_media_columns": op3_media_columns,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_counts": op5_token_counts,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sentencepiece": op10_sentencepiece,
}

__all__ = ["ORACLES", "QUERIES"]
