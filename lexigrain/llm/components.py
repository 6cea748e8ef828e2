"""Connected components of a link table by alternating star contractions.

Every step is a grouped minimum (combined before the shuffle) and an equi-join, so a node with very many links is
split like any skewed join key. Lineage is cut in the shared folder after each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for each node of ``edges``; component is the smallest node reachable. Nulls and self-links are
    ignored, repeated links count once, an empty table gives an empty result. Links may point either way."""
    low, high = F.least(u, v), F.greatest(u, v)
    now = edges.filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    now = checkpoint(now.select(high.alias("u"), low.alias("v")).distinct())  # u > v throughout
    before = None
    while (digest := _digest(now)) != before:
        before = digest
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        now = checkpoint(small.distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
