"""Connected components by alternating large-star and small-star, with tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, label for each node of edges (a, b): the smallest node that edges lead to.

    Each round points nodes at smaller neighbours and then at their root; it ends when all nodes
    point at roots, after about log2 of the longest path rounds.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "star")
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        low = materialize(low, "low")  # so that both sides of the join are plain exchanges and Spark can split a hub
        # Large star: larger neighbours of v point at v's smallest.
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # Small star: v and its smaller neighbours point at the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        nxt = small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        nxt = materialize(nxt, "star")
        moved = nxt.exceptAll(now).isEmpty() and now.exceptAll(nxt).isEmpty()
        discard(now, low)
        now = nxt
        if moved:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())
