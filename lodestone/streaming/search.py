"""Search over a stream of records.

Plain, operator and logical-free queries need no state: each record is scored as it comes
(append mode).  Token search weighs terms by document frequencies, which come from a
snapshot; ``fold_frequencies`` keeps such a snapshot up to date batch by batch.  Removed
records are tombstones, left out when results are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import SearchEngine
from ..operators.batch import BLOCK, block_hits, query_terms
from ..operators.tokens import document_frequencies, merged_frequencies
from ..options import SearchOptions


def _engine(stream: DataFrame, options, ref_index: str, text: str | None, frequencies) -> SearchEngine:
    engine = SearchEngine(stream, options, ref_index=ref_index, text=text)
    if engine.options.use_token_search:
        if frequencies is None:
            raise ValueError("token search over a stream needs a snapshot of frequencies: (fields, DataFrame of term, df)")
        fields, table = frequencies

        def snapshot(terms: list[str]):
            held = table.filter(F.col("term").isin(sorted(set(terms))))
            return fields, {r.term: r.df for r in held.collect()}

        engine.statistics = snapshot
    return engine


def search_stream(
    stream: DataFrame,
    query: str,
    options: SearchOptions | Mapping[str, Any] | None = None,
    ref_index: str = "ref_index",
    text: str | None = None,
    frequencies: tuple[int, DataFrame] | None = None,
) -> DataFrame:
    """The stream's matching records with ``ref_index`` and ``score``; not ordered, nothing is held."""
    engine = _engine(stream, options, ref_index, text, frequencies)
    return engine.scored(engine.rows, query).select(*engine.columns, "ref_index", "score")


def standing_queries(
    stream: DataFrame,
    queries: Sequence[tuple[Any, str]],
    options: SearchOptions | Mapping[str, Any] | None = None,
    ref_index: str = "ref_index",
    text: str | None = None,
    most_score: float | None = None,
    frequencies: tuple[int, DataFrame] | None = None,
) -> DataFrame:
    """``qid, ref_index, score`` of every record and standing query that match (score at most ``most_score``).

    Plain and token queries are scored together, BLOCK of them in one pass of the stream; an operator
    query, which is mostly native, takes a pass of its own.  Blank queries match nothing.
    """
    engine = _engine(stream, options, ref_index, text, frequencies)
    asked = [(qid, query) for qid, query in queries if query.strip()]
    if not asked:
        raise ValueError("no standing queries")
    if engine.options.use_extended_search:
        parts = [engine.scored(engine.rows, query).select(F.lit(qid).alias("qid"), "ref_index", "score") for qid, query in asked]
    else:
        terms = query_terms(stream.sparkSession, engine.options, [query for _, query in asked])
        blocks = [(qid, query, own) for (qid, query), own in zip(asked, terms)]
        parts = [block_hits(engine, blocks[k : k + BLOCK]) for k in range(0, len(blocks), BLOCK)]
    found = reduce(DataFrame.unionByName, parts)
    return found if most_score is None else found.filter(F.col("score") <= most_score)


def fold_frequencies(path: str, options, ref_index: str = "ref_index", text: str | None = None):
    """A ``foreachBatch`` function that adds each batch's term counts to the table at ``path``.

    Every batch writes ``path/version=<batch>`` from the version before it, so a batch that runs
    twice after a failure writes the same table; readers take the last version.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        engine = SearchEngine(batch, options, ref_index=ref_index, text=text)
        new = document_frequencies(engine.rows, engine.options)
        if batch_id > 0:
            new = merged_frequencies(spark.read.parquet(f"{path}/version={batch_id - 1}"), new)
        new.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return fold


def without_tombstones(results: DataFrame, removed: DataFrame, key: str = "ref_index") -> DataFrame:
    """Results whose record is not in the table of removed ones."""
    return results.join(removed.select(key).distinct(), key, "left_anti")


def top_k(results: DataFrame, k: int, score: Column | str = "score") -> DataFrame:
    """Best k of collected results."""
    return results.orderBy(score, "ref_index").limit(k)
