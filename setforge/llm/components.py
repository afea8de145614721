"""Connected components over distributed edges, by alternating large and small stars.

Each round rewires edges towards smaller ids and writes them to the shared
folder; rounds grow with the logarithm of the longest chain.  A hub costs one row
a task in the aggregates, and its joins are ones whose large partitions Spark
can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.shared import Shelf


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, shelf: Shelf, name: str = "components") -> DataFrame:
    """From edges (a, b): (node, component) for every node with an edge, the component's smallest node."""
    current = shelf.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    mark, turn = _mark(current), 0
    while mark[0]:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("u"), "m")
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = large.join(least, F.col("a") == F.col("u"))
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        turn += 1
        following = shelf.put(small, f"{name}-{turn}")
        after = _mark(following)
        shelf.drop(f"{name}-{turn - 1}")
        current = following
        if after == mark:
            break
        mark = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
