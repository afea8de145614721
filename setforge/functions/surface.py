"""Sketches in SQL text: functions of a session that give an element's points, without Python in the query.

    register_points(spark, "ghll_points", cfg)
    SELECT key, reg, max(k) AS k FROM rows, LATERAL ghll_points(x) GROUP BY key, reg

Registers equal those of ``sketches.build``.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from setforge.config import GeneralizedHyperLogLog, HyperLogLog, HyperMinHash, MinHash, Registers, SetSketch1


def bits_sql(scheme: str, x: str, salt: str | None, start: int, size: int) -> str:
    """What ``hashing.bits`` is as a column."""
    if scheme == "md5":
        text = x if salt is None else f"concat({x}, '|', cast({salt} AS string))"
        return f"cast(conv(substring(md5({text}), {start}, {size}), 16, 10) AS bigint)"
    return f"shiftrightunsigned(xxhash64({x}, cast({-1 if salt is None else salt} AS bigint), {(start - 1) // 15}), {64 - 4 * size})"


def unit_sql(scheme: str, x: str, salt: str | None) -> str:
    return f"(({bits_sql(scheme, x, salt, 9, 13)} + 0.5D) / {float(16**13)!r}D)"


def value_sql(x: str, b: float, q: int) -> str:
    return f"cast(greatest(0, least({q + 1}, floor(1 - ln({x}) / {math.log(b)!r}D))) AS bigint)"


def points_sql(cfg, x: str = "x") -> str:
    """An array of (reg, k) for the text ``x``."""
    one = "array(named_struct('reg', cast({0} AS int), 'k', cast({1} AS bigint)))"
    ones = f"bit_count({bits_sql(cfg.scheme, x, None, 1, 15)} ^ ({bits_sql(cfg.scheme, x, None, 1, 15)} + 1))"
    if isinstance(cfg, HyperLogLog):
        return one.format(f"shiftrightunsigned({bits_sql(cfg.scheme, x, None, 1, 15)}, {60 - cfg.p})", f"least({ones}, {cfg.q + 1})")
    if isinstance(cfg, GeneralizedHyperLogLog):
        return one.format(f"pmod({bits_sql(cfg.scheme, x, None, 1, 8)}, {cfg.m})", value_sql(unit_sql(cfg.scheme, x, None), cfg.b, cfg.q))
    if isinstance(cfg, HyperMinHash):
        value = f"least({ones}, {1 << cfg.bucket_size}) * {1 << cfg.sub_bits} + pmod({bits_sql(cfg.scheme, x, None, 22, 6)}, {1 << cfg.sub_bits})"
        return one.format(f"pmod({bits_sql(cfg.scheme, x, None, 16, 5)}, {cfg.m})", value)
    if isinstance(cfg, MinHash):
        point = bits_sql(cfg.scheme, x, "reg", 1, 15)
    elif isinstance(cfg, SetSketch1):
        point = value_sql(f"(-ln({unit_sql(cfg.scheme, x, 'reg')}) / {float(cfg.a)!r}D)", cfg.b, cfg.q)
    else:
        raise ValueError(f"{cfg.name} has no points in SQL")
    return f"transform(sequence(0, {cfg.m - 1}), reg -> named_struct('reg', reg, 'k', {point}))"


def register_points(spark: SparkSession, name: str, cfg: Registers | MinHash | HyperMinHash) -> None:
    """A table function ``name``(element) with columns reg and k."""
    if cfg.scheme == "marked":
        raise ValueError("the marked scheme draws points in Arrow kernels")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS TABLE(reg INT, k BIGINT) RETURN SELECT reg, k FROM inline({points_sql(cfg)})")
