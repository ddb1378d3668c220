"""Connected components of links within keys, by alternating star steps on Spark.

In a large-star step every node links its larger neighbours to the smallest node it knows; in a small-star step it links its
smaller ones to it. Each step is a map-side combined minimum and an equi join; the number of rounds grows with the
logarithm of the largest component. Rounds are written to the shared folder, so that a lost executor costs one round at
most; the driver sees a count and a checksum of each round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize


def _large_star(links: DataFrame, keys: list[str]) -> DataFrame:
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_e")
    both = links.select(*keys, ends).select(*keys, "_e.a", "_e.b")
    least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, [*keys, "a"]).filter("b > a").select(*keys, F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame, keys: list[str]) -> DataFrame:
    least = links.groupBy(*keys, "a").agg(F.min("b").alias("least"))
    moved = links.join(least, [*keys, "a"]).filter("b <> least").select(*keys, F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select(*keys, "a", F.col("least").alias("b"))).distinct()


def connected(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, root) of every linked node but the roots themselves; ``links``: keys, a, b.

    Nodes of different keys never meet. A root is the smallest node of its component."""
    keys = list(keys)
    now = links.filter("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    while True:
        # count and checksum are taken while the links are written
        noted = Observation()
        checksum = F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))
        now = materialize(now.observe(noted, F.count(F.lit(1)).alias("n"), checksum.alias("sum")), "links")
        total = noted.get
        if not total["n"] or total == seen:
            return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
        seen = total
        now = _small_star(_large_star(now, keys), keys)
