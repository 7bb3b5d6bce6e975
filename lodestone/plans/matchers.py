"""Queries compiled to columns: native predicates wherever the semantics allow, one Arrow call for the rest.

A compiled pattern maps a searchable value (struct with ``v`` and folded ``u``) and the probes of
the row to a result ``struct<m, score, inv, ranges, terms>``.  All fuzzy patterns of a query
share one Arrow UDF call over the row's folded values; its result is indexed natively.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FeatureUnavailable
from ..functions.bitap import ScanOptions, chunks_of, match_all
from ..functions.text import RANGE, fold_literal, merge_ranges, occurrences, strip_accents
from ..options import FEATURES, SearchOptions
from .extended import Term, parse_extended

RESULT = f"struct<m:boolean,score:double,inv:boolean,ranges:array<{RANGE}>,terms:array<int>>"
_RANGES = f"array<{RANGE}>"

_PROBE = T.ArrayType(
    T.StructType(
        [
            T.StructField("m", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        ]
    )
)
_PROBE_ARROW = pa.list_(pa.struct([("m", pa.bool_()), ("score", pa.float64()), ("ranges", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))


@dataclass
class Probes:
    """The fuzzy patterns of a query; the k-th of P belongs to entries k, k + P, ... of a row's probe array."""

    patterns: list[tuple[str, ScanOptions]] = field(default_factory=list)

    def add(self, pattern: str, options: ScanOptions) -> int:
        if (pattern, options) not in self.patterns:
            self.patterns.append((pattern, options))
        return self.patterns.index((pattern, options))

    def column(self, folded: Column) -> Column:
        """Probe array of an array of folded values.  Each distinct value of a batch is scanned once."""
        patterns = list(self.patterns)

        @F.arrow_udf(_PROBE)
        def probe(rows: pa.Array) -> pa.Array:
            rows = rows.to_pylist()
            values = list(dict.fromkeys(v for row in rows if row for v in row))
            found: list[list] = [[] for _ in values]
            for pattern, options in patterns:
                for out, f in zip(found, match_all(values, pattern, options)):
                    ranges = None if f.ranges is None else [{"start": a, "end": b} for a, b in f.ranges]
                    out.append({"m": f.is_match, "score": f.score, "ranges": ranges})
            known = dict(zip(values, found))
            return pa.array([None if row is None else [x for v in row for x in known[v]] for row in rows], _PROBE_ARROW)

        return probe.asNondeterministic()(folded)  # else a filter on it would run it twice

    def result(self, probes: Column, at: Column, k: int) -> Column:
        return F.get(probes, at * len(self.patterns) + k)


#: Maps (value, its position in the row, the row's probes) to a result.
Compiled = Callable[[Column, Column, Column], Column]


def result(m: Column, score: Column, inv: bool = False, ranges: Column | None = None, terms: Column | None = None) -> Column:
    return F.struct(
        F.coalesce(m, F.lit(False)).alias("m"),
        score.cast("double").alias("score"),
        F.lit(inv).alias("inv"),
        (F.lit(None) if ranges is None else ranges).cast(_RANGES).alias("ranges"),
        (F.lit(None) if terms is None else terms).cast("array<int>").alias("terms"),
    )


def no_match() -> Column:
    return result(F.lit(False), F.lit(1.0))


def _range(start: Column, end: Column) -> Column:
    return F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))


@dataclass
class Matcher:
    """A compiled query string.  gate: an inverse term may contribute; terms: how many of them
    ``token_match="all"`` wants covered; pieces: strings one of which any matching value contains
    (empty: unknown), for a filter ahead of the Arrow call."""

    evaluate: Compiled
    gate: bool = False
    terms: int | None = None
    pieces: tuple[str, ...] = ()
    nothing: bool = False


def native_fuzzy(pattern: str, o: ScanOptions) -> Callable[[Column], tuple[Column, Column]] | None:
    """Closed forms of the scan, as (match, score) of a folded value; None where there is none."""
    m = len(pattern)
    if not m or m > 32 or o.marks:
        return None
    equal = lambda u: u == F.lit(pattern)
    if o.ignore_location and o.threshold < 1 / m:
        if o.threshold < 0:
            return lambda u: (equal(u), F.when(equal(u), 0.0).otherwise(1.0))
        return lambda u: (u.contains(pattern), F.when(equal(u), 0.0).otherwise(0.001))
    if o.ignore_location or o.location > 0 or not 0 <= o.threshold < 1 / m:
        return None
    if not o.distance:
        return lambda u: (u.startswith(pattern), F.when(equal(u), 0.0).otherwise(0.001))
    place = lambda u: F.instr(u, pattern) - 1
    return lambda u: (
        (place(u) >= 0) & (place(u) / F.lit(float(o.distance)) <= F.lit(o.threshold)),
        F.when(equal(u), 0.0).otherwise(F.greatest(F.lit(0.001), place(u) / F.lit(float(o.distance)))),
    )


def pigeonholes(pattern: str, o: ScanOptions) -> tuple[str, ...]:
    """k errors leave one of k + 1 parts of the pattern whole; no parts if they would be single characters."""
    found: list[str] = []
    for piece, _ in chunks_of(pattern):
        k = max((i for i in range(len(piece)) if i / len(piece) <= o.threshold), default=0)
        if len(piece) // (k + 1) < 2:
            return ()
        cuts = [round(n * len(piece) / (k + 1)) for n in range(k + 2)]
        found += [piece[a:b] for a, b in zip(cuts, cuts[1:])]
    return tuple(dict.fromkeys(found))


def fuzzy(pattern: str, o: ScanOptions, probes: Probes) -> Compiled:
    if not pattern:
        return lambda s, i, p: no_match()
    if native := native_fuzzy(pattern, o):
        return lambda s, i, p: result(*native(s["u"]))
    k = probes.add(pattern, o)

    def evaluate(s: Column, i: Column, p: Column) -> Column:
        own = probes.result(p, i, k)
        return result(own["m"], own["score"], ranges=own["ranges"])

    return evaluate


def bitap_matcher(query: str, options: SearchOptions, probes: Probes) -> Matcher:
    pattern, o = fold_literal(query, options), ScanOptions.of(options)
    return Matcher(fuzzy(pattern, o, probes), pieces=pigeonholes(pattern, o) if pattern else ())


def _exact_term(term: Term, u: Column, marks: bool) -> tuple[Column, Column | None]:
    text, n = term.text, len(term.text)
    whole = _range(F.lit(0), F.length(u) - 1)
    found, ranges = {
        "exact": (u == F.lit(text), _range(F.lit(0), F.lit(n - 1))),
        "include": (u.contains(text), None),
        "prefix": (u.startswith(text), _range(F.lit(0), F.lit(n - 1))),
        "suffix": (u.endswith(text), _range(F.length(u) - n, F.length(u) - 1)),
        "inverse-prefix": (~u.startswith(text), whole),
        "inverse-suffix": (~u.endswith(text), whole),
        "inverse-exact": (~u.contains(text), whole),
    }[term.kind]
    if not marks:
        return found, None
    return found, occurrences(u, text) if ranges is None else ranges


def extended_matcher(query: str, options: SearchOptions, probes: Probes) -> Matcher:
    """First matching OR group wins; a group's score is the mean of its terms' scores."""
    groups = parse_extended(fold_literal(query, options))
    o, marks = ScanOptions.of(options), options.include_matches
    compiled = [[(t, fuzzy(t.text, o, probes) if t.kind == "fuzzy" else None) for t in group] for group in groups if group]

    def evaluate(s: Column, i: Column, p: Column) -> Column:
        out = None
        for group in compiled:
            ok, total, ranges = F.lit(True), F.lit(0.0), F.array().cast(_RANGES)
            for term, own in group:
                if own is not None:
                    r = own(s, i, p)
                    m, total, places = r["m"], total + r["score"], F.coalesce(r["ranges"], F.array().cast(_RANGES))
                else:
                    m, places = _exact_term(term, s["u"], marks)
                ok = ok & m
                ranges = F.concat(ranges, places) if marks else ranges
            hit = result(ok, total / len(group), any(t.inverse for t, _ in group), merge_ranges(ranges) if marks else None)
            out = F.when(ok, hit) if out is None else out.when(ok, hit)
        return no_match() if out is None else out.otherwise(no_match())

    return Matcher(evaluate, gate=any(t.inverse for g in groups for t in g), nothing=not compiled)


def default_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def tokens_of(text: Column, options: SearchOptions) -> Column:
    """Terms of a folded text: default runs of letters, marks, digits and ``_``; a regular
    expression; or a Python function ``str -> list[str]``, called in Arrow batches."""
    how = options.tokenize
    if how is None:
        return default_tokens(text)
    if isinstance(how, str) or hasattr(how, "pattern"):
        return F.regexp_extract_all(text, F.lit(how if isinstance(how, str) else how.pattern), F.lit(0))
    if not callable(how):
        raise TypeError(f"tokenize must be a pattern, a callable, or None; got {type(how).__name__}")

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def call(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else _checked(how(v)) for v in values.to_pylist()], pa.list_(pa.string()))

    return call(text)


def _checked(terms) -> list[str]:
    if not isinstance(terms, list) or not all(isinstance(t, str) for t in terms):
        raise TypeError(f"tokenize must return list[str]; got {type(terms).__name__}")
    return terms


def query_terms(query: str, options: SearchOptions, spark=None) -> list[str]:
    """The query's terms by the same analysis as the values'."""
    text, how = fold_literal(query, options), options.tokenize
    if callable(how) and not hasattr(how, "pattern"):
        return _checked(how(text))
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.active()
    return spark.range(1).select(tokens_of(F.lit(text), options).alias("t")).first().t


def idf_of(fields: int, holding: int) -> float:
    return math.log(1 + (fields - holding + 0.5) / (holding + 0.5))


def token_matcher(terms: list[str], idf: list[float], options: SearchOptions, probes: Probes) -> Matcher:
    o = ScanOptions.of(options, ignore_location=True)
    fold = (lambda t: t if options.is_case_sensitive else t.lower())
    searchers = [fuzzy(strip_accents(fold(t)) if options.ignore_diacritics else fold(t), o, probes) for t in terms]
    most, marks, every = sum(idf), options.include_matches, options.token_match == "all"

    def evaluate(s: Column, i: Column, p: Column) -> Column:
        found = [own(s, i, p) for own in searchers]
        gained, any_ = F.lit(0.0), F.lit(False)
        for r, weight in zip(found, idf):
            gained = gained + F.when(r["m"], F.lit(weight) * (1 - r["score"])).otherwise(0.0)
            any_ = any_ | r["m"]
        score = F.greatest(F.lit(0.001), 1 - gained / F.lit(most)) if most > 0 else F.lit(0.001)
        ranges = terms_ = None
        if marks:
            parts = [F.when(r["m"], F.coalesce(r["ranges"], F.array().cast(_RANGES))).otherwise(F.array().cast(_RANGES)) for r in found]
            ranges = F.nullif(merge_ranges(F.concat(*parts)), F.array().cast(_RANGES))
        if every:
            terms_ = F.array_compact(F.array(*(F.when(r["m"], k) for k, r in enumerate(found))))
        return result(any_, score, ranges=ranges, terms=terms_)

    if not searchers:
        return Matcher(lambda s, i, p: no_match(), nothing=True)
    return Matcher(evaluate, terms=len(terms) if every else None)


# Plugins: the first registered factory that accepts a query compiles it; else extended, token, plain.

_registry: list = []


def register(*factories) -> None:
    """Factories with ``accepts(query, options)`` and ``compile(query, options, probes) -> Matcher``."""
    _registry.extend(factories)


def registered() -> tuple:
    return tuple(_registry)


def clear_registry() -> None:
    _registry.clear()


def compile_query(query: str, options: SearchOptions, probes: Probes, statistics=None) -> Matcher:
    """statistics: terms -> (fields, {term: how many fields hold it}), for token search."""
    for factory in _registry:
        if factory.accepts(query, options):
            return factory.compile(query, options, probes)
    if options.use_extended_search:
        if not FEATURES["extended"]:
            raise FeatureUnavailable("Extended search is not available")
        return extended_matcher(query, options, probes)
    if options.use_token_search:
        if not FEATURES["token"]:
            raise FeatureUnavailable("Token search is not available")
        terms = query_terms(query, options)
        fields, holding = statistics(terms) if statistics else (0, {})
        return token_matcher(terms, [idf_of(fields, holding.get(t, 0)) for t in terms], options, probes)
    return bitap_matcher(query, options, probes)
