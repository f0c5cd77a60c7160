"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) of each linked node but the least of its component: the node, and that least one.

    Each round joins every node with the least of its neighbours, so the longest path halves or better. Only counts reach
    the driver; a hub's links meet its minimum in a join, whose large side Spark splits when it is skewed.
    """
    edges = checkpointed(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(small_least.select("a", F.col("m").alias("b"))).distinct()
        edges = checkpointed(small)
        # Stars are left when each node is either a parent or a child of one parent.
        roles = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if roles.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            return edges
