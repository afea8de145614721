"""Error statistics and goodness-of-fit tests as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setforge.operators import scan
from setforge.operators.keyed import join_on
from setforge.sources.stored import stored

#: Cells of probability of a Kolmogorov-Smirnov distance.
CELLS = 1 << 16
#: Most cells that are sent to every task; more are joined by sorting.
SENT = 1 << 15


def mse(x: Column, truth: Column) -> Column:
    return F.avg(F.pow(x - truth, F.lit(2)))


def mean(x: Column) -> Column:
    return F.avg(x)


def error_stats(x: Column, truth: Column) -> list[Column]:
    """mean, mse, population standard deviation and kurtosis (3 for a normal law)."""
    return [mean(x).alias("mean"), mse(x, truth).alias("mse"), F.stddev_pop(x).alias("std"), (F.kurtosis(x) + 3).alias("kurtosis")]


def chi_square(df: DataFrame, cell: str, cells: int, keys: list[str]) -> DataFrame:
    """(keys..., n, chi2) against equal shares of ``cells`` cells."""
    counts = df.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    return per.select(*keys, "n", (F.col("squares") * cells / F.col("n") - F.col("n")).alias("chi2"))


def ks_uniform(df: DataFrame, value: str, keys: list[str], cdf=lambda x: x) -> DataFrame:
    """(keys..., n, d): largest distance between the empirical and the given distribution.

    Counts, smallest and largest probability by cells of probability bound the distance inside each cell.
    Only the rows of cells that may exceed the largest distance known from the cells' ends are
    numbered, by a scan over ranges; the result is that of numbering all.
    """
    p, n = F.col("__p"), F.col("n")
    inside = F.least(F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * CELLS), F.lit(CELLS - 1)).cast("int")
    # the order of a sort: nulls first, no numbers last
    rows = df.select(*keys, cdf(F.col(value)).alias("__p")).withColumn("__cell", F.when(p.isNull(), -1).when(F.isnan(p), CELLS).otherwise(inside))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)

    def gap(i: Column, p: Column) -> Column:
        return F.greatest(i / n - p, p - (i - 1) / n)

    cells = rows.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__c"), F.min("__p").alias("__low"), F.max("__p").alias("__high"))
    cells = cells.select("*", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"), F.sum("__c").over(whole).alias("n"))
    last = F.col("__before") + F.col("__c")
    cells = cells.withColumn("__d", F.max(F.greatest(gap(F.col("__before") + 1, F.col("__low")), gap(last, F.col("__high")))).over(whole))
    cells = stored(cells, "ks-cells")
    known = cells.groupBy(*keys, "n").agg(F.max("__d").alias("d"))
    bound = F.greatest(last / n - F.col("__low"), F.col("__high") - F.col("__before") / n)
    # the rows of a cell with at most two are its ends
    open_ = cells.where("__c > 2").where(bound > F.col("__d")).select(*keys, "__cell", "__before", "n")
    few = open_.limit(SENT + 1).count() <= SENT
    ranked = scan.numbered(join_on(rows, open_.hint("broadcast" if few else "merge"), [*keys, "__cell"]), [*keys, "__cell"], ["__p"], "__i")
    closer = ranked.select(*keys, "n", gap(F.col("__before") + F.col("__i"), p).alias("d"))
    return known.unionByName(closer).groupBy(*keys, "n").agg(F.max("d").alias("d"))


def binomial_z(df: DataFrame, hit: Column, p: float, keys: list[str]) -> DataFrame:
    """(keys..., n, hits, z) of a Bernoulli sample."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("long")).alias("hits"))
    return counts.withColumn("z", (F.col("hits") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p)))
