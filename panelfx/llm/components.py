"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfx.session import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``a``, ``b``); the root is the smallest node.

    Every step is a grouped minimum and a join, and its result is written to
    the shared folder.  It ends when the edges are stars: each node but a root
    has one edge, and that leads to a root.  Nodes of any orderable type.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while not is_stars(current):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        previous, current = current, stored(small, "cc")
        drop_stored(current.sparkSession, previous)
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def is_stars(edges: DataFrame) -> bool:
    seen = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    uses = seen.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return uses.where("up > 1 or (up > 0 and down > 0)").isEmpty()
