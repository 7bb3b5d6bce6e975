"""Mixing sources to target weights by hierarchical budgets over a domain - language - source tree.

A budget of tokens flows from the root to the leaves.  At each node it is shared among the
children by weight; a child that cannot use its share (its subtree holds too few tokens for
the allowed epochs) is filled, and what it leaves goes to its siblings by weight.  Only what
all children of a node together cannot use is missing from the node's own capacity, and so
goes to the node's siblings: siblings come before ancestors.

Each leaf then takes a prefix of its documents' tokens from a sequence of epochs; epoch e
holds every document once, in the order of md5(seed:e:id).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixingParams:
    """share: budget as a part of all tokens (ignored if ``budget`` is given); epochs: how often a
    document may be used at most; weights: per level, child name -> weight among its siblings,
    others weigh their tokens to the power ``temper``; per_bucket: documents in a sorted run."""

    share: float = 0.8
    budget: int | None = None
    epochs: int = 1
    temper: float = 0.5
    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    seed: int = 4
    per_bucket: int = 1024


def domain_of(source: Column) -> Column:
    """The query's domains: the source's trailing number modulo 4, or ``none``."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", "none").otherwise(F.concat(F.lit("domain"), number.cast("int") % 4))


def _weight(level: str, name: str, params: MixingParams) -> Column:
    own = F.pow(F.col("tokens").cast("double"), F.lit(params.temper))
    for child, weight in params.weights.get(level, {}).items():
        own = F.when(F.col(name) == child, F.lit(float(weight))).otherwise(own)
    return own


def share_out(nodes: DataFrame, parents: DataFrame, above: list[str], level: str, params: MixingParams) -> DataFrame:
    """Budgets of a level's nodes from their parents' (water filling by two running sums).

    Children are sorted by capacity per weight.  As long as the first child's capacity is at
    most its share of what is left, it is filled; all behind the first that is not full share
    the rest by weight.
    """
    keyed = nodes.join(parents.select(*above, F.col("budget").alias("given")), above) if above else nodes.crossJoin(F.broadcast(parents.select(F.col("budget").alias("given"))))
    keyed = keyed.withColumn("weight", _weight(level, level, params)).withColumn("capacity", F.col("tokens") * params.epochs)
    order = Window.partitionBy(*above, F.lit(0)).orderBy(F.col("capacity") / F.col("weight"), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    keyed = keyed.withColumn("left", F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    keyed = keyed.withColumn("per", F.col("left") / F.sum("weight").over(rest))
    keyed = keyed.withColumn("full", F.col("capacity") <= F.col("per") * F.col("weight") * (1 + 1e-12))
    level_of_rest = F.min(F.when(~F.col("full"), F.struct(F.col("capacity") / F.col("weight"), F.col(level), F.col("per")))).over(Window.partitionBy(*above, F.lit(0)))
    budget = F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(level_of_rest["per"] * F.col("weight"))
    return keyed.select(*above, level, "tokens", F.least(budget, F.col("capacity").cast("double")).alias("budget"))


def leaf_budgets(leaves: DataFrame, params: MixingParams) -> DataFrame:
    """``domain, lang, source, tokens, docs, budget`` (whole tokens) from the leaves' tokens."""
    total = leaves.agg(F.sum("tokens").alias("tokens"))
    wanted = F.lit(params.budget).cast("double") if params.budget is not None else F.col("tokens") * F.lit(params.share)
    parents = total.select(F.least(F.floor(wanted), F.col("tokens") * params.epochs).cast("double").alias("budget"))
    for depth, level in enumerate(LEVELS):
        above = list(LEVELS[:depth])
        nodes = leaves.groupBy(*above, level).agg(F.sum("tokens").alias("tokens"))
        parents = share_out(nodes, parents, above, level, params)
    return leaves.join(parents.select(*LEVELS, F.floor(F.round("budget", 3)).cast("long").alias("budget")), list(LEVELS))


def prefix_sums(runs: DataFrame, per_block: int) -> DataFrame:
    """``ahead``: tokens of the leaf's runs before each.  First over blocks of ``per_block`` runs, then
    inside each block, so a window holds a leaf's rows divided by per_bucket times ``per_block`` at most."""
    blocked = runs.withColumn("block", F.floor(F.col("run") / per_block))
    above = Window.partitionBy(*LEVELS).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*LEVELS, "block").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(*LEVELS, "block").agg(F.sum("own").alias("all"))
    blocks = blocks.select(*LEVELS, "block", F.coalesce(F.sum("all").over(above), F.lit(0)).alias("base"))
    joined = blocked.join(blocks, [*LEVELS, "block"])
    return joined.select(*LEVELS, "run", "own", (F.col("base") + F.coalesce(F.sum("own").over(inside), F.lit(0))).alias("ahead"))


def mix_sources(
    docs: DataFrame,
    params: MixingParams = MixingParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per row ``doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, full_epochs,
    partial_tokens, kept``, and the columns of ``carry`` as ``carry_0, carry_1, ...``.

    Tokens are words.  A row is used ``full_epochs`` times whole, and in the next epoch its first
    ``partial_tokens`` tokens end the leaf's prefix or lie in it.  kept: any token is used.  Null
    languages and sources are named ``none``; null and empty texts hold no token and are not
    kept.  Rows of equal id and length are ordered by neither: they take equal places, one
    after the other.  A null id is allowed and sorted by an empty string.  Other columns are
    ignored; no rows give no rows.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (domain if domain is not None else domain_of(F.col(source_col))).alias("domain"),
        named(lang_col).alias("lang"),
        named(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
        *(F.col(f"`{c}`").alias(f"carry_{k}") for k, c in enumerate(carry)),
    )
    rows = settle(base, "mix-rows")
    leaves = settle(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).filter("tokens > 0"), "mix-leaves")
    budgets = settle(leaf_budgets(leaves, params), "mix-budgets")
    known = rows.join(budgets, list(LEVELS), "left")
    known = known.withColumn("full_epochs", F.coalesce(F.expr("budget div tokens"), F.lit(0)))
    known = known.withColumn("rest", F.coalesce(F.col("budget") - F.col("full_epochs") * F.col("tokens"), F.lit(0)))
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    known = known.withColumn("turn", F.md5(F.concat(F.lit(f"{params.seed}:"), F.col("full_epochs"), F.lit(":"), text_id).cast("binary")))
    # Runs of about per_bucket documents by the order's leading digits, so that no leaf is sorted in one task.
    runs = F.coalesce(F.ceil(F.col("docs") / params.per_bucket), F.lit(1))
    known = known.withColumn("run", F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * runs / F.lit(1 << 32)).cast("long"))
    sums = known.groupBy(*LEVELS, "run").agg(F.sum("n_tokens").alias("own"))
    sums = prefix_sums(settle(sums, "mix-runs"), params.per_bucket)
    known = known.join(sums, [*LEVELS, "run"])
    # Only a run in which the prefix ends has to be sorted.
    ends = (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("own") > F.col("rest"))
    settled = known.filter(~ends).withColumn("partial", F.when(F.col("ahead") + F.col("own") <= F.col("rest"), F.col("n_tokens")).otherwise(0))
    order = Window.partitionBy(*LEVELS, "run").orderBy("turn", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    open_ = known.filter(ends).withColumn("before", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    open_ = open_.withColumn("partial", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("before"))))
    carried = [f"carry_{k}" for k in range(len(carry))]
    out = ["doc_id", *LEVELS, "n_tokens", "tokens", "budget", "full_epochs", "partial", *carried]
    return (
        settled.select(*out)
        .unionByName(open_.select(*out))
        .select(
            "doc_id",
            *LEVELS,
            "n_tokens",
            F.coalesce("tokens", F.lit(0)).alias("leaf_tokens"),
            F.coalesce("budget", F.lit(0)).alias("leaf_budget"),
            F.col("full_epochs").cast("long").alias("full_epochs"),
            F.col("partial").cast("long").alias("partial_tokens"),
            ((F.col("full_epochs") > 0) & (F.col("n_tokens") > 0) | (F.col("partial") > 0)).alias("kept"),
            *carried,
        )
    )
