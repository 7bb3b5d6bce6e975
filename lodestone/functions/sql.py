"""Functions for SQL: ``fuzzy_match(pattern, text)`` and ``fuzzy_score(pattern, text)``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import SearchOptions
from .bitap import ScanOptions, match_all
from .text import fold_literal


def _scores(patterns: list, texts: list, options: SearchOptions) -> list[float | None]:
    """Score of each pair (None: no match or a null), one scan per distinct pattern."""
    scan = ScanOptions.of(options, include_matches=False)
    by_pattern: dict[str, list[int]] = {}
    for k, (p, t) in enumerate(zip(patterns, texts)):
        if p and t is not None:
            by_pattern.setdefault(p, []).append(k)
    out: list[float | None] = [None] * len(texts)
    for pattern, rows in by_pattern.items():
        folded = [fold_literal(texts[k], options) for k in rows]
        for k, found in zip(rows, match_all(folded, fold_literal(pattern, options), scan)):
            out[k] = found.score if found.is_match else None
    return out


def register_functions(spark: SparkSession, options=None, **more) -> None:
    """Register both functions with the given search options; they take any two string columns."""
    o = SearchOptions.coerce(options, **more)

    @F.arrow_udf(T.DoubleType())
    def fuzzy_score(pattern: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array(_scores(pattern.to_pylist(), text.to_pylist(), o), pa.float64())

    @F.arrow_udf(T.BooleanType())
    def fuzzy_match(pattern: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array([s is not None for s in _scores(pattern.to_pylist(), text.to_pylist(), o)], pa.bool_())

    spark.udf.register("fuzzy_score", fuzzy_score)
    spark.udf.register("fuzzy_match", fuzzy_match)
