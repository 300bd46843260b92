"""Connected components by alternating large and small stars, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtflow.llm.shared import stored


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, or itself; partial sums make a hub cheap."""
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).withColumn("least", F.least("a", "least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them. Edges go from the larger node to the smaller."""
    joined = edges.join(_least(edges), "a")
    return joined.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node in edges (a, b).

    Loops and repeated edges do no harm; null ends are left out. Rounds grow with the logarithm of the longest path, and each is
    written to the shared folder.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", compact=True)
    mark = None
    while True:
        now = stored(_small_star(_large_star(now)).filter("a <> b").distinct(), "edges", compact=True)
        # a sum over the edges that only a fixed point repeats
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
