"""Connected components of a graph in a DataFrame, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _nearest(pairs: DataFrame) -> DataFrame:
    """Each node u of pairs (u, v) with m, the smallest of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Neighbours v of u that `keep` lets through are joined to the smallest of u's neighbourhood instead of to u."""
    return pairs.join(_nearest(pairs), "u").filter(keep).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """A row (node, component) for every node that an edge joins to another; component is the smallest node that can be reached.

    Node ids are any ordered type. Repeated edges, loops and either direction make no difference, null ends make no edge, an empty
    table gives an empty result. Every step keeps at most as many edges as there were and is written to the shared folder; the
    number of steps grows as the logarithm of the longest path. Minima are pre-aggregated before the shuffle, so a node with very
    many neighbours is no more work in one place than its rows in one join, which splits where it is skewed.
    """
    now = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna().filter("a <> b").distinct()
    now = common.settled(now)
    before = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, F.col("v") > F.col("u"))
        # every edge from the larger to the smaller end; the smaller neighbours of u, and u itself, join the smallest
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = common.settled(small.filter("a <> b").distinct())
        # done when nothing moves: the sum of hashes stands for the set of edges
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = sign
