"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import staged


def components(links: DataFrame) -> DataFrame:
    """v, root (the smallest vertex it is connected with) for every vertex of links (a, b). Each round is
    a written table; hot vertices are minimised before the shuffle, and joins may split them."""
    edges = staged(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        edges = staged(_star(edges, large=True), "large-stars")
        edges = staged(_star(edges, large=False).distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with b the smaller; large: of neighbours above a vertex, small: of those below it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    # written first, so that the join has plain shuffles on both sides and can split a hot vertex
    low = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lowest")
    joined = both.join(low, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return moved.where("a <> b")
