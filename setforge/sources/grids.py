"""Sources of the simulations: cardinality grids, set triples and synthetic ids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.sources.stored import stored


def cardinality_grid(largest: int, step: float) -> list[int]:
    """0 and cardinalities up to ``largest``, each about 1 + step times the one before."""
    found, c = [0], largest
    while c > 0:
        found.append(c)
        c = min(c - 1, math.ceil(c / (1 + step)))
    return sorted(found)


def one_two_five(largest: int = 10_000_000) -> list[int]:
    return [d * 10**e for e in range(len(str(largest))) for d in (1, 2, 5) if d * 10**e <= largest]


def triples(unions: tuple[int, ...] = (1_000_000, 1000), jaccards: tuple[int, ...] = (2, 10, 100, 1000), ratio: float = 1.2, most: float = 1000) -> list[tuple[int, int, int]]:
    """(difference1, difference2, intersection) for unions, Jaccard similarities 1/x and growing ratios of the differences."""
    found = set()
    for union in unions:
        for part in jaccards:
            both, r = union // part, 1.0
            while True:
                one = math.floor((union - both) / (1 + 1 / r))
                two = union - both - one
                found.add((one, two, both))
                if one >= most * two:
                    break
                r *= ratio
    return sorted(found)


def grid_frame(spark: SparkSession, values: list[int], name: str = "cardinality") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} bigint").orderBy(name)


def triples_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(triples(), "diff1 bigint, diff2 bigint, intersection bigint")


def ids(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n ids: hashes of (index, seed)."""
    return spark.range(n).select(F.col("id").alias("index"), F.xxhash64("id", F.lit(seed)).alias("element"))


def example_streams(spark: SparkSession, examples: int, n: int, seed: int, scheme: str = "xxhash64") -> DataFrame:
    """(example, i, element): independent streams of n elements; for md5 the element is text that any database can make."""
    rows = spark.range(examples * n).select(F.floor(F.col("id") / n).cast("int").alias("example"), (F.col("id") % n).alias("i"))
    return rows.withColumn("element", F.concat_ws("|", F.lit(str(seed)), "example", "i") if scheme == "md5" else F.xxhash64(F.lit(seed), "example", "i"))


def both_ways(df: DataFrame, one, two) -> tuple[DataFrame, DataFrame]:
    """The same elements into two plans, computed once."""
    df = stored(df, "both-ways")
    return one(df), two(df)


def maxima(grid: DataFrame) -> DataFrame:
    """One row with the largest value of each column of a grid."""
    return grid.agg(*(F.max(c).alias(c) for c in grid.columns))
