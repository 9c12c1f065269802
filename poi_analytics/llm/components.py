"""Connected components of an edge table by alternating stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poi_analytics.llm.shared import drop_saved, saved


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) pairs with m, the smallest of u and all its v."""
    least = (pairs.groupBy("u").agg(F.min("v").alias("m"))
             .select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
    return pairs.join(least, pairs.u == least.k).select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (_with_minimum(both).where("v > u and v != m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    small = _with_minimum(large)
    return (small.select("u", F.col("m").alias("v"))
            .union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where("u != v").distinct())


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): each node of ``edges`` with the smallest node it reaches.

    Large-star and small-star steps alternate until the edges are stars; every
    round is written to the shared folder, and the last one read is the result.
    Each step is a grouped minimum (combined before the shuffle) and an equi-join,
    which AQE splits at hub nodes.  Null or self edges are ignored.
    """
    now = saved(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
                .where(F.col("u") != F.col("v")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or not seen[0]:
            break
        mark, before = seen, now
        now = saved(_round(now), "edges")
        drop_saved(before)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
