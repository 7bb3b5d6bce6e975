"""Corpus statistics of token search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import SearchOptions
from ..plans.matchers import tokens_of


#: Up to so many query terms are counted as columns of one aggregate, more by a join with the terms.
MOST_COLUMNS = 40


def term_rows(rows: DataFrame, options: SearchOptions) -> DataFrame:
    """Distinct terms of each value: ``ref_index, terms``; values without terms are left out."""
    each = rows.select("ref_index", F.explode("subs.u").alias("u"))
    terms = each.select("ref_index", F.array_distinct(tokens_of(F.col("u"), options)).alias("terms"))
    return terms.filter(F.size("terms") > 0)


def document_frequencies(rows: DataFrame, options: SearchOptions) -> DataFrame:
    """``term, df``: how many values hold each term."""
    return term_rows(rows, options).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def statistics(rows: DataFrame, options: SearchOptions, terms: list[str]) -> tuple[int, dict[str, int]]:
    """Number of values with any term, and of those that hold each of ``terms``; the driver gets a number per query term."""
    wanted = sorted(set(terms))
    held = term_rows(rows, options)
    if len(wanted) > MOST_COLUMNS:
        spark = rows.sparkSession
        asked = spark.createDataFrame([(t,) for t in wanted], "term string")
        found = held.select(F.explode("terms").alias("term")).join(F.broadcast(asked), "term").groupBy("term").agg(F.count("*").alias("n"))
        return held.count(), {r.term: r.n for r in found.collect()}
    counts = held.agg(F.count("*").alias("n"), *(F.count_if(F.array_contains("terms", t)).alias(f"t{k}") for k, t in enumerate(wanted))).first()
    return counts.n, {t: counts[f"t{k}"] for k, t in enumerate(wanted)}


def merged_frequencies(old: DataFrame, new: DataFrame, sign: int = 1) -> DataFrame:
    """Frequencies after values were added (sign 1) or removed (-1); terms that nothing holds go."""
    signed = old.unionByName(new.select("term", (F.col("df") * sign).alias("df")))
    return signed.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
