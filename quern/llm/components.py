"""Connected components of a graph given as edges, for graphs of any size.

Rounds of large-star and small-star rewriting: each round is two aggregations, its edges are
written to the shared folder, and the number of rounds grows with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import kept, scratch, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones and itself) are tied to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = both.join(least, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a bigint, b bigint); root is the least node of its component.

    Nulls are no nodes, and loops and repeated edges change nothing.
    """
    signs = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    with scratch(edges.sparkSession):  # the rounds before the last
        edges = stored(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b").distinct(), "edges")
        before = edges.agg(*signs).first()
        while True:
            edges = stored(_star(_star(edges, True), False), "edges")
            now = edges.agg(*signs).first()
            if now == before:
                break
            before = now
        edges = kept(edges, "stars")
    # a fixed point is one star for each component
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
