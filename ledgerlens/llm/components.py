"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(
        F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    larger = both.where("b > a").join(least, "a").where("b != m")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; ``a > b`` holds."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b != m").select(
        F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return own.unionByName(others).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns ``a``, ``b``).

    A component is named by its smallest node. Loops, nulls and repeated edges do no harm;
    a node with loops only is not returned. Every step reduces on its key before it joins,
    each round ends in a reliable checkpoint, and nothing but two numbers a round reaches
    the driver. The rounds grow with the logarithm of the longest path.
    """
    now = cut_lineage(edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        now = cut_lineage(small_star(large_star(now)))
        before, mark = mark, _mark(now)
    roots = now.select(F.col("b").alias("node")).distinct()
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))
