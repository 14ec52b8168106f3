"""Connected components of an edge table by alternating stars, native joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Result: node, comp (the smallest node reachable), for nodes with an edge.

    Large star: each node sends its larger neighbours its smallest one. Small star: each node
    joins its smaller neighbours to the smallest. Both keep the components; when neither changes
    anything every node points at its root. Each round is two aggregations with map-side
    combining and two joins that adaptive execution splits, so a hub is no bottleneck.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _state(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a")
        small = star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = materialize(small.filter("a <> b").distinct())
        state = _state(now)
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def join_components(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components of ``known`` (node, comp: an earlier result) with more links (a, b)."""
    return components(known.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(links.select("a", "b")))
