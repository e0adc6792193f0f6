"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.storage import discard, stored


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Edges (a, b), a > b, with each node's larger (or, one way, all smaller) neighbours tied to its smallest one."""
    flat = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else edges
    # Written first, both sides of the join are plain shuffles, so that Spark can split the edges of a hub among tasks.
    least = stored(flat.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m")), "least")
    joined = flat.join(least, F.col("a") == F.col("of"))
    if both_ways:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label, its component's smallest node, for the nodes of ``edges`` (a, b) other than the smallest themselves. Loops and repeated edges do no harm."""
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        large = stored(_star(now, True), "large")
        small = stored(_star(large, False), "small")
        discard(now, large)
        now = small
        # Done when all is stars: every node has one label, and labels have none.
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up")).distinct())
        if ends.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
