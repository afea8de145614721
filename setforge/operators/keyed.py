"""Equi-joins in which null keys are keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the further columns of ``right`` (none for semi and anti joins); hashing and sorting work as for plain equality."""
    named = right.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= left[k].eqNullSafe(named[f"__key{i}"])
    return left.join(named, same, how).drop(*(f"__key{i}" for i in range(len(keys))))
