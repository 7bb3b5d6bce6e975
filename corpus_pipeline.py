"""Corpus pipeline: quality, exact copies, near copies, source weights, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All but
the last return the columns of ``documents``; the last one the encoding of what is left.

A row is known by its doc_id together with its text, null-safe: rows that share an id but not
the text, and rows without an id, are judged each for itself.

Stages that run Python bound the session's Arrow batches by bytes, unless they are bounded already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches, settle, table
from lodestone.llm.exact import exact_duplicates, normalised
from lodestone.llm.minhash import MinHashParams, near_duplicates
from lodestone.llm.mixing import MixingParams, mix_sources
from lodestone.llm.quality import quality_scores
from lodestone.llm.tokens import encode_decode

#: Keys of dropped rows are broadcast only if they were counted and are at most so many (some 50 MB).
MOST_BROADCAST_KEYS = 500_000

KEY = "__row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """With a digest of the text, which the operators hand on."""
    return docs.withColumn(KEY, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def _without(docs: DataFrame, dropped: DataFrame, key, name: str) -> DataFrame:
    """``docs`` without the rows whose doc_id and ``key`` are in ``dropped`` (doc_id, key)."""
    gone = settle(dropped.toDF("gone_id", "gone_key").distinct(), name)
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST_KEYS else gone
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (key == F.col("gone_key")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the classifier's threshold go.

    The columns of ``docs`` pass through the scoring, so nothing is joined and every row is
    judged by its own text; null and empty texts get the score of no features.
    """
    bound_batches(spark)
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    return scored.filter("predicted = 1").select(*(F.col(f"carry_{k}").alias(c) for k, c in enumerate(docs.columns)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space one row stays, of the smallest doc_id (null ids come last).

    Repeated rows with one id are copies too: of rows that share id and normalised text the one
    whose columns come first as JSON stays.  Null texts equal empty ones.
    """
    told = exact_duplicates(docs)
    digest = F.sha2(normalised(F.col("text")), 256)
    left = _without(docs, told.filter("not kept").select("doc_id", "text_sha256"), digest, "copies")
    again = settle(told.filter("kept").groupBy("text_sha256").agg(F.count("*").alias("n")).filter("n > 1").select("text_sha256"), "repeated")
    if again.isEmpty():
        return left
    small = F.broadcast(again) if again.count() <= MOST_BROADCAST_KEYS else again
    left = left.withColumn(KEY, digest)
    once = left.join(small, F.col(KEY) == F.col("text_sha256"), "left_anti").drop(KEY)
    twice = left.join(small, F.col(KEY) == F.col("text_sha256"), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = twice.groupBy(KEY).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return once.unionByName(first.select("row.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similarities of 0.8 or more (shingles of five words) the one with
    the smallest doc_id stays.  Rows without an id, words or text are linked with nothing and stay."""
    bound_batches(spark)
    told = near_duplicates(_keyed(docs), MinHashParams(shingle=5, percent=80), carry=(KEY,))
    return _without(_keyed(docs), told.filter("not kept").select("doc_id", "carry_0"), F.col(KEY), "near-copies").drop(KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's seeded prefix of tokens under hierarchical budgets of 90 % of all tokens; a
    document of which any token is used stays whole, one without any token (null or empty) goes."""
    told = mix_sources(_keyed(docs), MixingParams(share=0.9), carry=(KEY,))
    return _without(_keyed(docs), told.filter("not kept").select("doc_id", "carry_0"), F.col(KEY), "over-budget").drop(KEY)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids, decoded back; one row per row, null and empty texts have no ids."""
    bound_batches(spark)
    return encode_decode(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: None: classifier, similarity classes and segmentation have no SQL form; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
