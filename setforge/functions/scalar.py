"""Scalar functions as columns: series kernels, error theory, collision bounds, register laws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def x_over_expm1(x: Column) -> Column:
    """x / (e^x - 1), 1 at 0."""
    return F.when(x == 0, 1.0).otherwise(F.try_divide(x, F.expm1(x)))


def expm1_over_x(x: Column) -> Column:
    """(e^x - 1) / x, 1 at 0."""
    return F.when(x == 0, 1.0).otherwise(F.try_divide(F.expm1(x), x))


def log1p_over_x(x: Column) -> Column:
    """ln(1 + x) / x, 1 at 0."""
    return F.when(x == 0, 1.0).otherwise(F.try_divide(F.log1p(x), x))


def effective_base(sub_bits: Column | int) -> Column:
    return F.pow(F.lit(2.0), F.pow(F.lit(2.0), -_lit(sub_bits)))


def hll_alpha(m: Column | int) -> Column:
    """Bias constants of raw HyperLogLog estimates."""
    m = _lit(m)
    return F.when(m == 16, 0.673).when(m == 32, 0.697).when(m == 64, 0.709).otherwise(0.7213 / (1 + 1.079 / m))


def relative_error(mean: Column, truth: Column) -> Column:
    return F.try_divide(mean - truth, truth)


def expected_rsd(b: Column | float, m: Column | int) -> Column:
    """Relative standard deviation of cardinality estimates."""
    b, m = _lit(b), _lit(m)
    return F.sqrt(((b + 1) / (b - 1) * F.ln(b) - 1) / m)


def space_efficiency(b: Column | float, largest: float) -> Column:
    """Relative standard deviation of one register times the root of the bits it needs up to ``largest``."""
    return expected_rsd(b, 1) * F.sqrt(F.log2(F.ln(F.lit(largest)) / F.ln(_lit(b))))


def p_b(b: Column | float, x: Column) -> Column:
    """-log_b(1 - x (b - 1) / b)."""
    b = _lit(b)
    return -F.log1p(-x * (b - 1) / b) / F.ln(b)


def collision_lower(b: Column | float, jaccard: Column) -> Column:
    """Least probability that two registers are equal."""
    b = _lit(b)
    return F.log1p(jaccard * (b - 1)) / F.ln(b)


def collision_upper(b: Column | float, jaccard: Column) -> Column:
    b = _lit(b)
    return F.log1p(jaccard * (b - 1) + F.pow(1 - jaccard, F.lit(2)) * F.pow(b - 1, F.lit(2)) / (4 * b)) / F.ln(b)


def jaccard_lower(b: Column | float, equal_share: Column) -> Column:
    """Least Jaccard similarity that explains a share of equal registers."""
    b = _lit(b)
    return F.greatest(F.lit(0.0), 2 * F.expm1(F.ln(b) * (equal_share + 1) / 2) / (b - 1) - 1)


def jaccard_upper(b: Column | float, equal_share: Column) -> Column:
    b = _lit(b)
    return F.expm1(F.ln(b) * equal_share) / (b - 1)


def minhash_mse(jaccard: Column, m: Column | int) -> Column:
    return jaccard * (1 - jaccard) / _lit(m)


def minhash_relative_rmse(jaccard: Column, m: Column | int) -> Column:
    return F.sqrt((1 - jaccard) / (jaccard * _lit(m)))


def superminhash_relative_rmse(jaccard: Column, m: int, union: Column) -> Column:
    """MinHash error times the square root of the SuperMinHash variance factor for a union of this size."""
    share = lambda x, whole: F.pow(x / F.lit(float(whole)), union)
    curved = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.lit(m - 1)), lambda i: i.cast("double")),
        F.lit(0.0),
        lambda total, i: total + share(i, m - 1) * (share(i + 1, m) + share(i - 1, m) - 2 * share(i, m)),
    )
    return minhash_relative_rmse(jaccard, m) * F.sqrt(1 - curved * (m - 1) / (union - 1))


def fisher_terms(b: Column | float, u: Column, jaccard: Column) -> Column:
    """Fisher information of one register pair about the Jaccard similarity, shares u and 1 - u known."""
    b = _lit(b)
    v = 1 - u
    slope = lambda x: (b - 1) / (b * F.ln(b)) / (1 - x * (b - 1) / b)
    x, y = u - v * jaccard, v - u * jaccard
    px, py = p_b(b, x), p_b(b, y)
    dx, dy = -v * slope(x), -u * slope(y)
    rest = 1 - px - py
    square = lambda c: F.pow(c, F.lit(2))
    return F.coalesce(F.try_divide(square(dx), px), F.lit(0.0)) + F.coalesce(F.try_divide(square(dy), py), F.lit(0.0)) + F.coalesce(F.try_divide(square(dx + dy), rest), F.lit(0.0))


def fisher_rse(b: Column | float, m: Column | int, u: Column, jaccard: Column) -> Column:
    """Relative standard error of the Jaccard similarity by Fisher information."""
    return F.try_divide(F.lit(1.0), jaccard * F.sqrt(_lit(m) * fisher_terms(b, u, jaccard)))


def difference_rse(b: Column | float, m: Column | int, u: Column, jaccard: Column) -> Column:
    """Relative standard error of the first difference, (u - v J) / (1 + J) of the total."""
    v = 1 - u
    return F.try_divide(F.lit(1.0), F.sqrt(_lit(m) * fisher_terms(b, u, jaccard)) * (u - v * jaccard) * (1 + jaccard))


def intersection_rse(b: Column | float, m: Column | int, u: Column, jaccard: Column) -> Column:
    """Relative standard error of the intersection, J / (1 + J) of the total."""
    return F.try_divide(F.lit(1.0), F.sqrt(_lit(m) * fisher_terms(b, u, jaccard)) * jaccard * (1 + jaccard))


def rmse_against_minhash(b: Column | float, u: Column, jaccard: Column) -> Column:
    return F.try_divide(F.lit(1.0), F.sqrt(fisher_terms(b, u, jaccard) * jaccard * (1 - jaccard)))


def upper_bound_mse(b: float, m: int, jaccard: Column) -> Column:
    """Mean squared error of the upper Jaccard bound when equal registers are binomial, in closed form.

    Variance and bias each have a form without cancellation, so bases near 1 keep their digits.
    """
    p, step = collision_upper(b, jaccard), math.expm1(math.log(b) / m)
    mean = F.expm1(F.log1p(p * step) * m)  # of b^(share of equal registers), less 1
    variance = F.pow(mean + 1, F.lit(2)) * F.expm1(F.log1p(p * (1 - p) * F.pow(step / (1 + p * step), F.lit(2))) * m) / (b - 1) ** 2
    return variance + F.pow(mean / (b - 1) - jaccard, F.lit(2))


def ghll_cdf(b: Column | float, k: Column) -> Column:
    return 1 - F.pow(_lit(b), -k)


def setsketch_cdf(b: Column | float, rate: Column | float, k: Column) -> Column:
    return F.exp(-_lit(rate) * F.pow(_lit(b), -k))


def hyperminhash_cdf(sub_bits: int, k: Column) -> Column:
    """P(update value <= k) of one element: each of the exponent's halves is spread evenly over its values."""
    width = 1 << sub_bits
    whole = F.ceil(k / width) - 1
    half = F.pow(F.lit(2.0), -(whole + 1))
    return F.when(k <= 0, 0.0).otherwise(1 - 2 * half + half * (k - whole * width) / width)
