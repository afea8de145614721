"""Running numbers and aggregates over ordered keys, without a task that holds a key.

Rows are range-partitioned by key and order, so that a key with many rows spans
many partitions, and stored sorted.  Each partition then knows its own counts and
aggregates; what all earlier partitions of a key add up to, its carry, comes from
one row a key and partition.  A second pass adds the carry to what a window inside
the partition gives.  Rows that are equal in key and order are told apart by a
number, so that a range may end between them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setforge.operators.keyed import join_on
from setforge.sources.stored import stored

_PART, _AT, _TIE = "__part", "__at", "__tie"
#: Aggregates that can run on, and how a carry joins them.
COMBINED = {
    "sum": (F.sum, lambda own, carry: F.coalesce(own + carry, own, carry)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def ordered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` by ranges of keys and order, with the range's number and each row's place over all ranges."""
    by = [*(F.col(c).asc_nulls_first() for c in (*keys, *order)), F.col(_TIE)]
    ranged = df.withColumn(_TIE, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    # after the sort this is the range's number and, in the lower 33 bits, the place in it
    rows = stored(ranged.withColumn(_AT, F.monotonically_increasing_id()).drop(_TIE), "ordered")
    return rows.withColumn(_PART, F.shiftright(_AT, 33))


def numbered(df: DataFrame, keys: list[str], order: list[str], number: str, total: str | None = None) -> DataFrame:
    """``df`` with each row's number in its key's order, from 1, and the key's number of rows."""
    rows = ordered(df, keys, order)
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*keys, _PART).agg(F.count(F.lit(1)).alias("__n"), F.min(_AT).alias("__first"))
    per = per.select(*keys, _PART, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) + 1 - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("__total"))
    out = join_on(rows, per, [*keys, _PART]).withColumn(number, F.col(_AT) + F.col("__shift"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop(_PART, _AT, "__shift", "__total")


def running(df: DataFrame, keys: list[str], order: list[str], value: str, how: str, name: str) -> DataFrame:
    """``df`` with the ``how`` (sum, max or min) of ``value`` over a key's rows so far."""
    aggregate, joined = COMBINED[how]
    rows = ordered(df, keys, order)
    inside = Window.partitionBy(_PART, *keys).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*keys, _PART).agg(aggregate(value).alias("__own"))
    per = per.select(*keys, _PART, aggregate("__own").over(earlier).alias("__carry"))
    return join_on(rows, per, [*keys, _PART]).withColumn(name, joined(aggregate(value).over(inside), F.col("__carry"))).drop(_PART, _AT, "__carry")
