"""Connected components over an edge table: alternating star contraction, each round settled in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.common import forget, stored


def _signature(edges: DataFrame) -> tuple:
    """Tells one set of edges from another: their number and two independent sums over 64-bit hashes."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.hash("b", "a").cast("long"))).first())


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the least node of its component. rows: about how many edges there are.

    Each round points every node's greater neighbours, then its lesser ones, at the least of them, until nothing changes.
    Node counts and edges never reach the driver; rounds grow with the logarithm of the longest path.
    """
    star = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    before = _signature(star)
    while True:
        # large star: every neighbour of a node that is greater than it is linked to the least neighbour (itself included)
        both = star.select("a", "b").unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its lesser neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges", before[0])
        now = _signature(following)
        if now == before:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        forget(star)
        star, before = following, now
