"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironquill.llm.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``: long): root is the smallest node it is linked with.

    Alternates two contractions: each node hands its larger neighbours, then its
    smaller ones, to its smallest. The number of rounds grows with the
    logarithm of the longest path. A node's neighbours are never gathered: its
    smallest one is an aggregate, handed back by a join that Spark splits where
    a node has many. Each round is written to the shared folder.
    """
    current = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        large = _contract(current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        small = _contract(large, larger=False)
        current = small
        # Done when all are stars: no root has a root, and no node has two.
        if (current.groupBy("a").count().filter("count > 1").isEmpty()
                and current.alias("x").join(current.alias("y"), F.col("x.b") == F.col("y.a"), "left_semi").isEmpty()):
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _contract(edges: DataFrame, larger: bool) -> DataFrame:
    """``edges`` a, b: a and its neighbours b (all of them, or the smaller ones)."""
    least = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m")), "least")
    joined = edges.join(least, "a")
    if larger:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
    return cut(out.filter("a <> b").distinct(), "edges")
