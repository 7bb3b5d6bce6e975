"""Many queries in one pass, fuzzy joins, and what is built on them."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import SearchEngine
from ..functions.bitap import ScanOptions, match_all
from ..functions.text import fold_literal
from ..options import SearchOptions
from ..plans.matchers import idf_of, tokens_of
from .score import HIT, row_score
from .values import folded

#: Queries of one pass: they are sent to the executors with the code.
BLOCK = 2_000

_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("q", T.IntegerType()),
            T.StructField("hits", T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
            T.StructField("covered", T.IntegerType()),
        ]
    )
)
_FOUND_ARROW = pa.list_(pa.struct([("q", pa.int32()), ("hits", pa.list_(pa.struct([("i", pa.int32()), ("score", pa.float64())]))), ("covered", pa.int32())]))


class _Scorer:
    """Scores of every query for a list of distinct values; patterns shared by queries are scanned once."""

    def __init__(self, queries: list[tuple[list[str], list[float]]], options: ScanOptions, tokens: bool):
        self.queries, self.options, self.tokens = queries, options, tokens

    def run(self, values: list[str]) -> list[dict[int, tuple[float, int]]]:
        """Per value: query -> (score, mask of its matching terms)."""
        known: dict[str, list] = {}
        for terms, _ in self.queries:
            for t in terms:
                if t and t not in known:
                    known[t] = match_all(values, t, self.options)
        matching = {t: [(k, f.score) for k, f in enumerate(found) if f.is_match] for t, found in known.items()}
        out: list[dict[int, tuple[float, int]]] = [{} for _ in values]
        for q, (terms, idf) in enumerate(self.queries):
            terms = [(n, matching[t], w) for n, (t, w) in enumerate(zip(terms, idf)) if t]
            if not self.tokens:
                for k, score in terms[0][1] if terms else ():
                    out[k][q] = (score, 1)
                continue
            most = sum(idf)
            gained: dict[int, tuple[float, int]] = {}
            for n, found, weight in terms:  # in the order of the query's terms
                for k, score in found:
                    sofar, mask = gained.get(k, (0.0, 0))
                    gained[k] = (sofar + weight * (1 - score), mask | 1 << n)
            for k, (sofar, mask) in gained.items():
                out[k][q] = (max(0.001, 1 - sofar / most if most > 0 else 0.0), mask)
        return out


def _probe(scorer: _Scorer, every: bool):
    @F.arrow_udf(_FOUND)
    def probe(rows: pa.Array) -> pa.Array:
        rows = rows.to_pylist()
        values = list(dict.fromkeys(v for row in rows if row for v in row))
        known = dict(zip(values, scorer.run(values)))
        out = []
        for row in rows:
            found: dict[int, list] = {}
            masks: dict[int, int] = {}
            for i, v in enumerate(row or ()):
                for q, (score, mask) in known[v].items():
                    found.setdefault(q, []).append({"i": i, "score": score})
                    masks[q] = masks.get(q, 0) | mask
            full = lambda q: not every or masks[q] == (1 << len(scorer.queries[q][0])) - 1
            out.append([{"q": q, "hits": hits, "covered": masks[q].bit_count()} for q, hits in found.items() if full(q)])
        return pa.array(out, _FOUND_ARROW)

    return probe.asNondeterministic()


def block_hits(engine: SearchEngine, block: list[tuple]) -> DataFrame:
    """``qid, ref_index, score`` of a block of (qid, query, terms)."""
    o = engine.options
    if o.use_token_search:
        split = [terms for _, _, terms in block]
        fields, holding = engine.statistics(sorted({t for terms in split for t in terms}))
        fold = [[fold_literal(t, o) for t in terms] for terms in split]
        compiled = [(f, [idf_of(fields, holding.get(t, 0)) for t in terms]) for f, terms in zip(fold, split)]
        scan = ScanOptions.of(o, ignore_location=True)
    else:
        compiled = [([fold_literal(q, o)], [1.0]) for _, q, _ in block]
        scan = ScanOptions.of(o)  # matches without ranges are none, as in a single search
    probe = _probe(_Scorer(compiled, scan, o.use_token_search), o.use_token_search and o.token_match == "all")
    rows = engine.values.select("ref_index", "subs", F.explode(probe(F.transform("subs", lambda s: s["u"]))).alias("f"))
    hit = lambda h: F.struct(
        F.get("subs", h["i"])["key_idx"].alias("key_idx"),
        F.get("subs", h["i"])["arr_idx"].alias("arr_idx"),
        F.get("subs", h["i"])["v"].alias("v"),
        F.get("subs", h["i"])["norm"].alias("norm"),
        h["score"].alias("score"),
        F.lit(False).alias("inv"),
        F.lit(None).alias("ranges"),
        F.lit(None).alias("terms"),
    )
    hits = F.transform("f.hits", hit).cast(f"array<{HIT}>")
    ids = F.array(*(F.lit(q) for q, *_ in block))
    return rows.select(F.get(ids, F.col("f.q")).alias("qid"), "ref_index", row_score(hits, engine._active, o).alias("score"))


def _with_terms(queries: DataFrame, options: SearchOptions) -> DataFrame:
    """With ``terms`` of each ``query``, analysed as the values are; null unless tokens are searched."""
    if not options.use_token_search:
        return queries.withColumn("terms", F.lit(None))
    return queries.withColumn("terms", tokens_of(F.get(folded(F.array("query"), options), F.lit(0)), options))


def query_terms(spark: SparkSession, options: SearchOptions, queries: Sequence[str]) -> list[list[str] | None]:
    """Terms of each query, from one small job; None unless tokens are searched."""
    if not options.use_token_search:
        return [None] * len(queries)
    asked = spark.createDataFrame(list(enumerate(queries)), "n int, query string")
    return [r.terms for r in _with_terms(asked, options).orderBy("n").collect()]


def search_many(engine: SearchEngine, queries: DataFrame, limit: int = -1, qid: str = "qid", query: str = "query") -> DataFrame:
    """``qid, ref_index, score, rank`` of every query's best rows (all matches if ``limit`` is below 0).

    Plain and token queries go BLOCK at a time through one Arrow call a row batch; operator
    queries and plugins one after the other.  Blank queries match nothing here.
    """
    spark = queries.sparkSession
    wanted = queries.select(F.col(qid).alias("qid"), F.col(query).alias("query")).filter(F.btrim("query") != "").distinct()
    wanted = _with_terms(wanted, engine.options)
    found = None
    block: list[tuple] = []

    def flush():
        nonlocal found, block
        if not block:
            return
        if engine.options.use_extended_search:
            parts = [engine.scored(engine.rows, q).select(F.lit(i).alias("qid"), "ref_index", "score") for i, q, _ in block]
        else:
            parts = [block_hits(engine, block)]
        for p in parts:
            found = p if found is None else found.unionByName(p)
        block = []

    for r in wanted.orderBy("qid").toLocalIterator():
        block.append((r.qid, r.query, r.terms))
        if len(block) >= (50 if engine.options.use_extended_search else BLOCK):
            flush()
    flush()
    if found is None:
        kind = wanted.schema["qid"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField("qid", kind), T.StructField("ref_index", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "ref_index")))
    return ranked if limit < 0 else ranked.filter(F.col("rank") <= limit)


def bands(score: Column, names: Sequence[str], bounds: Sequence[float]) -> Column:
    """The first name whose bound the score is below; the last name from the last bound on, and without a score."""
    out = F.lit(names[-1])
    for name, bound in reversed(list(zip(names, bounds))):
        out = F.when(score < bound, name).otherwise(out)
    return F.when(score.isNull(), names[-1]).otherwise(out)


def fuzzy_join(
    probe: DataFrame,
    engine: SearchEngine,
    on: Sequence[str],
    qid: str,
    names: Sequence[str] = ("matched", "review", "missing"),
    bounds: Sequence[float] = (0.55, 0.80),
) -> DataFrame:
    """Every probe row with its best match: ``qid, ref_index, score, band`` (nulls where nothing matches)."""
    text = F.concat_ws(" ", *(F.col(c).cast("string") for c in on))
    ids = probe.select(F.col(qid).alias("qid"), text.alias("query"))
    best = search_many(engine, ids, 1).drop("rank")
    return ids.select("qid").distinct().join(best, "qid", "left").withColumn("band", bands(F.col("score"), names, bounds))


def without_partner(rows: DataFrame, key: str, joined: DataFrame, partner: str, band: str = "missing") -> DataFrame:
    """Rows that no joined pair outside ``band`` names in ``partner``."""
    taken = joined.filter((F.col("band") != band) & F.col(partner).isNotNull()).select(F.col(partner).alias(key)).distinct()
    return rows.join(taken, key, "left_anti")


def triage(tickets: DataFrame, engine: SearchEngine, on: Sequence[str], qid: str, route: float = 0.75, escalate: float = 0.82) -> DataFrame:
    """Best match of each ticket with a band: ``auto`` below ``route``, ``escalate`` above ``escalate``, else ``review``."""
    joined = fuzzy_join(tickets, engine, on, qid)
    band = F.when(F.col("score") < route, "auto").when(F.col("score") <= escalate, "review").otherwise("escalate")
    return joined.withColumn("band", band)
