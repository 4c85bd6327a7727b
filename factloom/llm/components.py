"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    """Least neighbour of each node, itself included (combines before the shuffle)."""
    return stage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "cc-least")


def components(links: DataFrame) -> DataFrame:
    """links (a, b), any order -> node, root: the least node reachable, for linked nodes.

    Alternating large-star and small-star steps; each keeps connectivity, and the tables
    become one star a component in a logarithmic number of rounds. Both sides of every join
    are plain exchanges, so that Spark can split the partition of a hot centre.
    """
    edges = stage(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    before = None
    while True:
        both = stage(_both(edges), "cc-both")
        large = stage(both.filter("b > a").join(_least(both), "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
        small = large.join(_least(large), "a")
        edges = stage(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
