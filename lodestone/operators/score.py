"""Hits of a row, their gates, the row's score, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import SearchOptions
from ..plans.keys import KeySet
from ..plans.matchers import Matcher

EPSILON = 2.0**-52
HIT = "struct<key_idx:int,arr_idx:int,v:string,norm:double,score:double,inv:boolean,ranges:array<struct<start:int,end:int>>,terms:array<int>>"


def hits_of(matcher: Matcher, subs: Column, probes: Column, key_idx: int | None = None) -> Column:
    """The row's matching values, in the order of keys and array elements."""

    def one(s: Column, i: Column) -> Column:
        r = matcher.evaluate(s, i, probes)
        return F.struct(s["key_idx"].alias("key_idx"), s["arr_idx"].alias("arr_idx"), s["v"].alias("v"), s["norm"].alias("norm"), r.alias("r"))

    found = F.transform(subs, one)
    own = lambda x: x["r"]["m"] if key_idx is None else (x["key_idx"] == key_idx) & x["r"]["m"]
    flat = F.transform(
        F.filter(found, own),
        lambda x: F.struct(
            x["key_idx"].alias("key_idx"),
            x["arr_idx"].alias("arr_idx"),
            x["v"].alias("v"),
            x["norm"].alias("norm"),
            x["r"]["score"].alias("score"),
            x["r"]["inv"].alias("inv"),
            x["r"]["ranges"].alias("ranges"),
            x["r"]["terms"].alias("terms"),
        ),
    )
    return F.coalesce(flat, F.array()).cast(f"array<{HIT}>")


def row_score(hits: Column, keys: KeySet, options: SearchOptions) -> Column:
    """Product over the hits, in their order, of score to the power weight times norm."""
    weights = F.array(*(F.lit(float(k.weight)) for k in keys.keys)) if len(keys) else F.array(F.lit(1.0))

    def factor(h: Column) -> Column:
        weight = F.get(weights, h["key_idx"])
        base = F.when((h["score"] == 0) & weight.isNotNull(), F.lit(EPSILON)).otherwise(h["score"])
        norm = F.lit(1.0) if options.ignore_field_norm else h["norm"]
        return F.pow(base, F.coalesce(weight, F.lit(1.0)) * norm)

    return F.aggregate(hits, F.lit(1.0), lambda acc, h: acc * factor(h))


def _hits_of_key(hits: Column, k: int) -> Column:
    return F.filter(hits, lambda h: h["key_idx"] == k)


def passes_gates(matcher: Matcher, hits: Column, keys: KeySet, strings: bool) -> Column:
    """At least one hit; with an inverse first hit of a key, a hit in every key; all terms covered if wanted."""
    ok = F.size(hits) > 0
    if matcher.gate and not strings and len(keys):
        per_key = [_hits_of_key(hits, k) for k in range(len(keys))]
        failed, inverse = F.lit(False), F.lit(False)
        for own in per_key:
            failed = failed | (F.size(own) == 0)
            inverse = inverse | F.coalesce(F.get(own, F.lit(0))["inv"], F.lit(False))
        ok = ok & ~(inverse & failed)
    if matcher.terms is not None:
        covered = F.array_distinct(F.flatten(F.transform(hits, lambda h: h["terms"])))
        ok = ok & (F.size(covered) == matcher.terms)
    return ok


def shown_matches(hits: Column, keys: KeySet) -> Column:
    """Hits with ranges: ``indices, value, key, ref_index``; the last two only where they apply."""
    ids = F.array(*(F.lit(k.id) for k in keys.keys)) if len(keys) else F.array().cast("array<string>")
    return F.transform(
        F.filter(hits, lambda h: F.coalesce(F.size(h["ranges"]), F.lit(0)) > 0),
        lambda h: F.struct(
            h["ranges"].alias("indices"), h["v"].alias("value"), F.get(ids, h["key_idx"]).alias("key"), h["arr_idx"].alias("ref_index")
        ),
    )
