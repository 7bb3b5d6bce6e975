"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is tied to the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of those neighbours."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = settle(down.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    tied = down.join(least, "u")
    return (
        tied.select(F.col("m").alias("u"), "v")
        .unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node that has a link; component: the least node reachable.

    links: longs ``u`` and ``v``.  Null ends and loops are ignored, repeated links and
    either direction are fine, no links give no rows.  Each round is written to the
    shared folder.  Only two aggregates of a round reach the driver.  Minima are
    combined before the shuffle, written, and joined back by a plain join of two tables,
    whose skewed partitions Spark splits, so a hub's neighbours need not meet in one task.
    """
    edges = settle(links.filter("u <> v").select("u", "v").distinct(), "cc")
    seen = None
    for _ in range(most_rounds):
        now = edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        edges = settle(_small_star(_large_star(edges)), "cc")
    else:
        raise RuntimeError(f"links not settled after {most_rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
