"""Counter-based randomness: every draw is a hash of (id, step), so nothing has state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setforge.functions.hashing import bits, unit


def n_bits(scheme: str, x: Column, step: Column | int, n: int) -> Column:
    """The next n (up to 60) bits of an element's stream, high bits first."""
    digits = (n + 3) // 4
    return F.shiftrightunsigned(bits(scheme, x, step, 1, digits), 4 * digits - n)


def one_bit(scheme: str, x: Column, step: Column | int, at: int) -> Column:
    """Bit ``at`` of the same stream, 0 the first."""
    return F.shiftrightunsigned(bits(scheme, x, step, 1, 15), 59 - at).bitwiseAND(F.lit(1))


def from_bits(singles: list[Column]) -> Column:
    """The number whose binary digits are given, first highest."""
    total = F.lit(0).cast("bigint")
    for b in singles:
        total = total * 2 + b
    return total


def uniform(scheme: str, x: Column, step: Column | int) -> Column:
    return unit(scheme, x, step, 1, 13)


def uniform_half(scheme: str, x: Column, step: Column | int) -> Column:
    """Uniform in (0, 1/2)."""
    return uniform(scheme, x, step) / 2


def exponential(scheme: str, x: Column, step: Column | int) -> Column:
    return -F.ln(uniform(scheme, x, step))


def bernoulli(scheme: str, x: Column, step: Column | int, p: float) -> Column:
    return uniform(scheme, x, step) < p


def bernoulli_ratio(scheme: str, x: Column, step: Column | int, numerator: int, denominator: int) -> Column:
    return uniform_int(scheme, x, step, denominator) < numerator


def log2_floor(v: Column) -> Column:
    """Number of binary digits less one."""
    return F.length(F.bin(v)) - 1


def uniform_int(scheme: str, x: Column, step: Column | int, n: int) -> Column:
    """Uniform in 0 .. n-1; powers of two take bits, others scale a 52-bit uniform."""
    if n & (n - 1) == 0:
        return n_bits(scheme, x, step, max(1, n.bit_length() - 1)) if n > 1 else F.lit(0).cast("bigint")
    return F.floor(uniform(scheme, x, step) * n).cast("bigint")


def truncated_exponential(scheme: str, x: Column, step: Column | int, rate: float) -> Column:
    """Exponential on [0, 1) by its inverse distribution."""
    return -F.log1p(uniform(scheme, x, step) * math.expm1(-rate)) / rate


def truncated_exponential_cdf(x: Column, rate: float) -> Column:
    return F.expm1(-x * rate) / math.expm1(-rate)


def permutation(df: DataFrame, scheme: str, x: str, item: str, size: int) -> DataFrame:
    """For each element a random order of 0 .. size-1: adds ``item`` and ``place``."""
    rows = df.withColumn(item, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    order = Window.partitionBy(x).orderBy(bits(scheme, F.col(x), F.col(item), 1, 15), item)
    return rows.withColumn("place", F.row_number().over(order) - 1)


#: name: (draw from (scheme, element, step), kind, cells, distribution for real values).
GENERATORS = {
    "uniform": (uniform, "real", None, lambda x: x),
    "uniform_half": (uniform_half, "real", None, lambda x: x * 2),
    "exponential": (exponential, "real", None, lambda x: 1 - F.exp(-x)),
    **{f"bernoulli_{p}": (lambda s, x, t, p=p: bernoulli(s, x, t, p).cast("long"), "binomial", p, None) for p in (0.1, 0.5, 0.9)},
    **{f"bernoulli_{a}_{b}": (lambda s, x, t, a=a, b=b: bernoulli_ratio(s, x, t, a, b).cast("long"), "binomial", a / b, None) for a, b in ((1, 3), (5, 7))},
    **{f"uniform_int_{n}": (lambda s, x, t, n=n: uniform_int(s, x, t, n), "integer", n, None) for n in (2, 3, 5, 6, 7, 8, 11, 12, 16)},
    **{f"truncated_exponential_{r}": (lambda s, x, t, r=r: truncated_exponential(s, x, t, r), "real", None, lambda x, r=r: truncated_exponential_cdf(x, r)) for r in (0.1, 0.5, 1.0, 2.0)},
    "one_bit": (lambda s, x, t: one_bit(s, x, t, 0), "binomial", 0.5, None),
}
