"""Connected components of a table of links, by alternating large-star and small-star steps; each round is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _downward(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger node (u) to the smaller (v)."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return _downward(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _downward(moved.union(least.select("u", F.col("m").alias("v"))))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (columns u, v: long), component being the smallest node that can be reached.

    Links with themselves and repeated links do no harm; an empty table gives an empty result.
    """
    edges, before = stored(_downward(links), "links"), None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before:
            break
        before = state
        edges = stored(_small_star(_large_star(edges)), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
