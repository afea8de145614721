"""Joint quantities of two sets from their sketches.

``pairs`` joins sketch rows of chosen pairs of keys register by register and
counts how they compare; one row a pair then holds all that the estimators need.
Closed forms are column expressions; the likelihood searches are a fixed number of
golden-section steps inside one expression, so they stay in the JVM.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.config import HyperMinHash, MinHash, Registers
from setforge.functions.scalar import jaccard_lower, jaccard_upper
from setforge.operators import cardinality, families
from setforge.operators.points import hyperminhash_to_ghll, hyperminhash_to_hll
from setforge.sources.stored import stored

QUANTITIES = ("difference1", "difference2", "intersection", "cardinality1", "cardinality2", "union", "jaccard", "cosine", "inclusion1", "inclusion2", "alpha", "beta")
PAIR = ["k1", "k2"]


# ---- derived quantities ---------------------------------------------------


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def derived(difference1: Column, difference2: Column, intersection: Column) -> Column:
    """All twelve quantities; ratios with nothing to divide by are 0."""
    given = F.struct(difference1.cast("double").alias("d1"), difference2.cast("double").alias("d2"), intersection.cast("double").alias("i"))
    return let(given, lambda s: _derived(s["d1"], s["d2"], s["i"]))


def _derived(difference1: Column, difference2: Column, intersection: Column) -> Column:
    n1, n2 = difference1 + intersection, difference2 + intersection
    union = difference1 + difference2 + intersection
    found = dict(zip(QUANTITIES, (difference1, difference2, intersection, n1, n2, union, _ratio(intersection, union), _ratio(intersection, F.sqrt(n1 * n2)), _ratio(intersection, n1), _ratio(intersection, n2), _ratio(difference1, union), _ratio(difference2, union))))
    return F.struct(*(c.cast("double").alias(n) for n, c in found.items()))


def from_jaccard(n1: Column, n2: Column, jaccard: Column) -> Column:
    """Quantities from cardinalities and a Jaccard similarity, which is clipped to what they allow."""
    most = F.least(F.coalesce(F.try_divide(n1, n2), F.lit(0.0)), F.coalesce(F.try_divide(n2, n1), F.lit(0.0)))
    clipped = F.greatest(F.lit(0.0), F.least(jaccard, most))

    def split(s: Column) -> Column:
        n1, n2, j = s["n1"], s["n2"], s["j"]
        y = 1 / (1 + j)
        shared = lambda n: F.when(j == 0, 0.0).otherwise(n * j)  # noqa: E731  (also of a saturated sketch, whose cardinality is infinite)
        return derived(F.greatest(F.lit(0.0), n1 - shared(n2)) * y, F.greatest(F.lit(0.0), n2 - shared(n1)) * y, shared(n1 + n2) * y)

    return let(F.struct(n1.cast("double").alias("n1"), n2.cast("double").alias("n2"), clipped.alias("j")), split)


def from_union(n1: Column, n2: Column, union: Column) -> Column:
    return from_jaccard(n1, n2, _ratio(n1 + n2 - union, union))


def from_alpha_beta(n1: Column, n2: Column, alpha: Column, beta: Column) -> Column:
    """From shares only in one set; negative rests mean disjoint sets."""
    rest = 1 - alpha - beta
    return from_jaccard(n1, n2, F.when(rest < 0, 0.0).otherwise(rest))


# ---- comparing registers --------------------------------------------------


def pairs(cfg, sketches: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(k1, k2, d_plus, d_minus, d_equal, both_zero, both_top, filled) for the pairs in ``wanted``.

    d_plus counts registers larger in the first sketch.  Registers missing in both
    are equal; ``filled`` counts registers present in either and ``matches`` those
    equal and present.
    """
    regs = sketches.select(F.col(key).alias("__key"), "reg", "k")
    ones = wanted.join(regs.withColumnRenamed("k", "a"), F.col("k1") == F.col("__key")).select(*PAIR, "reg", "a", F.lit(None).cast("bigint").alias("b"))
    twos = wanted.join(regs.withColumnRenamed("k", "b"), F.col("k2") == F.col("__key")).select(*PAIR, "reg", F.lit(None).cast("bigint").alias("a"), "b")
    # a union and a grouped maximum instead of a full outer join: one shuffle, and it combines before it
    both = ones.withColumn("a", F.col("a").cast("bigint")).unionByName(twos.withColumn("b", F.col("b").cast("bigint"))).groupBy(*PAIR, "reg").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    empty = families.empty(cfg)
    a, b = F.coalesce("a", F.lit(empty)), F.coalesce("b", F.lit(empty))
    top = getattr(cfg, "q", 1 << 60) + 1
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    counted = both.groupBy(*PAIR).agg(
        count(a > b).alias("d_plus"), count(a < b).alias("d_minus"), count((a == top) & (b == top)).alias("both_top"), F.count(F.lit(1)).alias("filled"), count(a == b).alias("matches")
    )
    return counted.withColumn("d_equal", F.lit(cfg.m) - F.col("d_plus") - F.col("d_minus")).withColumn("both_zero", F.lit(cfg.m) - F.col("filled"))


def difference_histogram(sketches: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(k1, k2, difference, c) over registers that either sketch touched."""
    regs = sketches.select(F.col(key).alias("__key"), "reg", F.col("k").cast("long").alias("k"))
    ones = wanted.join(regs, F.col("k1") == F.col("__key")).select(*PAIR, "reg", "k")
    twos = wanted.join(regs, F.col("k2") == F.col("__key")).select(*PAIR, "reg", (-F.col("k")).alias("k"))
    return ones.unionByName(twos).groupBy(*PAIR, "reg").agg(F.sum("k").alias("difference")).groupBy(*PAIR, "difference").agg(F.count(F.lit(1)).alias("c"))


def with_cardinalities(compared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Add n1 and n2 from (key, estimate)."""
    one = found.select(F.col(key).alias("k1"), F.col("estimate").alias("n1"))
    two = found.select(F.col(key).alias("k2"), F.col("estimate").alias("n2"))
    return compared.join(one, "k1").join(two, "k2")


def union_estimate(cfg, sketches: DataFrame, key: str, wanted: DataFrame, estimate) -> DataFrame:
    """(k1, k2, union): the sketches are merged pair by pair, then estimated."""
    sides = wanted.select(*PAIR, F.explode(F.array("k1", "k2")).alias("__of"))
    rows = sides.join(sketches.select(F.col(key).alias("__of"), "reg", "k"), "__of").select(*PAIR, "reg", "k")
    merged = rows.groupBy(*PAIR, "reg").agg(families.best(cfg))
    return estimate(cfg, merged, PAIR).withColumnRenamed("estimate", "union")


# ---- likelihood searches --------------------------------------------------

GOLDEN = (math.sqrt(5) - 1) / 2


def golden_section(f, low: Column, high: Column, steps: int = 60) -> Column:
    """Where a unimodal function of a column is largest in [low, high]."""

    def narrowed(state: Column, _: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        inner = F.struct((hi - (hi - lo) * GOLDEN).alias("x1"), (lo + (hi - lo) * GOLDEN).alias("x2"))

        def chosen(x: Column) -> Column:
            return let(f(x["x1"]) >= f(x["x2"]), lambda left: F.struct(F.when(left, lo).otherwise(x["x1"]).alias("lo"), F.when(left, x["x2"]).otherwise(hi).alias("hi")))

        return let(inner, chosen)

    start = F.struct(low.cast("double").alias("lo"), high.cast("double").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, narrowed, lambda s: (s["lo"] + s["hi"]) / 2)


def _times_log(count: Column, x: Column) -> Column:
    """count * ln(x), 0 without counts, very small for impossible values."""
    return F.when(count == 0, 0.0).otherwise(count * F.ln(F.greatest(x, F.lit(1e-300))))


def jaccard_ml(b: float, n1: Column, n2: Column, d_plus: Column, d_minus: Column, d_equal: Column) -> Column:
    """Jaccard similarity of largest likelihood given how registers compare."""
    u = F.try_divide(n1, n1 + n2)
    v = 1 - u
    log_b, share = math.log(b), (b - 1) / b

    def likelihood(j: Column) -> Column:
        p = -F.log1p(-F.greatest(F.lit(0.0), u - v * j) * share) / log_b
        q = -F.log1p(-F.greatest(F.lit(0.0), v - u * j) * share) / log_b
        return let(F.struct(p.alias("p"), q.alias("q")), lambda s: _times_log(d_plus, s["p"]) + _times_log(d_minus, s["q"]) + _times_log(d_equal, 1 - s["p"] - s["q"]))

    most = F.least(F.try_divide(n1, n2), F.try_divide(n2, n1))  # 0 where one of them is infinite
    return F.when((n1 > 0) & (n2 > 0), golden_section(likelihood, F.lit(0.0), most)).otherwise(0.0)


def jaccards_ml(b: float, n1, n2, d_plus, d_minus, d_equal, steps: int = 44, least: float | None = None) -> np.ndarray:
    """``jaccard_ml`` for many pairs at once, by bisection on the derivative; pairs whose maximum is below ``least`` may be given 0."""
    n1, n2, plus, minus, equal = (np.asarray(v, float) for v in (n1, n2, d_plus, d_minus, d_equal))
    out, live = np.zeros(len(n1)), np.flatnonzero((n1 > 0) & (n2 > 0) & np.isfinite(n1) & np.isfinite(n2))
    n1, n2, plus, minus, equal = (v[live] for v in (n1, n2, plus, minus, equal))
    u, log_b, share = n1 / (n1 + n2), math.log(b), (b - 1) / b
    v = 1 - u

    def rises(j: np.ndarray) -> np.ndarray:
        sides = [(own, other, np.maximum(0.0, own - other * j) * share) for own, other in ((u, v), (v, u))]
        p, q = (np.maximum(-np.log1p(-x) / log_b, 1e-300) for _, _, x in sides)
        dp, dq = (other * share / (1 - x) / log_b for _, other, x in sides)  # by how much they fall
        return equal * (dp + dq) / np.maximum(1 - p - q, 1e-300) > plus * dp / p + minus * dq / q

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    if least is not None:
        keep = np.flatnonzero((hi >= least - 1e-9) & rises(np.full(len(u), max(0.0, least - 1e-6))))
        live, u, v, plus, minus, equal, lo, hi = (x[keep] for x in (live, u, v, plus, minus, equal, lo, hi))
    for _ in range(steps):
        mid = (lo + hi) / 2
        up = rises(mid)
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    out[live] = (lo + hi) / 2
    return out


def jaccard_ml_udf(b: float):
    """``jaccards_ml`` as a function of columns, for many pairs; ``jaccard_ml`` needs no Python, for few."""

    def solve(n1: pd.Series, n2: pd.Series, p: pd.Series, q: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series(jaccards_ml(b, n1, n2, p, q, e))

    solve.__annotations__ = {**{c: pd.Series for c in ("n1", "n2", "p", "q", "e")}, "return": pd.Series}
    return F.pandas_udf(solve, "double")


def mu(b: float, x: np.ndarray, y: np.ndarray, first: int | None = None, last: int | None = None) -> np.ndarray:
    """Sum over all integers k (or those from ``first`` to ``last``) of exp(-x b^-k) - exp(-y b^-k)."""
    x, y = np.broadcast_arrays(np.asarray(x, float), np.asarray(y, float))
    top = np.log(np.maximum(np.maximum(x, y).max(initial=0.0), 1e-300)) / math.log(b)
    bottom = np.log(np.maximum(np.minimum(x, y).min(initial=1.0), 1e-12)) / math.log(b)
    low, high = int(math.floor(bottom - 7 / math.log(b))), int(math.ceil(top + 40 / math.log(b)))
    k = np.arange(low if first is None else max(first, low), (high if last is None else min(last, high)) + 1)
    scale = b ** -k.astype(float)
    return (np.exp(-x[..., None] * scale) * -np.expm1(-(y - x)[..., None] * scale)).sum(axis=-1)


def jaccards_corrected(cfg: Registers, n1, n2, d_plus, d_minus, d_equal, both_zero) -> np.ndarray:
    """Likelihood search, of many pairs at once, that tells registers untouched by both from others that are equal; 0 where a cardinality is missing, 0 or infinite."""
    whole = [np.asarray(v, float) for v in (n1, n2, d_plus, d_minus, d_equal, both_zero)]
    live = (whole[0] > 0) & (whole[1] > 0) & np.isfinite(whole[0]) & np.isfinite(whole[1])
    n1, n2, d_plus, d_minus, d_equal, both_zero = (v[live][:, None] for v in whole)
    b, rate, out = cfg.b, cfg.rate, np.zeros(len(live))

    def terms(j: np.ndarray) -> np.ndarray:
        whole = rate * (n1 + n2) / (1 + j)
        # larger in the first: at most k + 1 of what only it has, at most k of the second, less both at most k
        p, q = (mu(b, rate * (np.maximum(0.0, own - other * j) / (b * (1 + j)) + other), whole, 0, cfg.q) for own, other in ((n1, n2), (n2, n1)))
        equal = 1 - p - q - np.exp(-whole)
        parts = ((d_plus, p), (d_minus, q), (d_equal - both_zero, equal))
        return -both_zero * whole + sum(np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0.0) for n, x in parts)

    lo, hi = np.zeros_like(n1), np.minimum(n1 / n2, n2 / n1)
    for _ in range(12):
        grid = lo + (hi - lo) * np.linspace(0, 1, 21)
        best = np.argmax(terms(grid), axis=1)[:, None]
        lo, hi = np.take_along_axis(grid, np.maximum(0, best - 1), 1), np.take_along_axis(grid, np.minimum(20, best + 1), 1)
    out[live] = ((lo + hi) / 2)[:, 0]
    return out


def _corrected_udf(cfg: Registers):
    def solve(n1: pd.Series, n2: pd.Series, p: pd.Series, q: pd.Series, e: pd.Series, z: pd.Series) -> pd.Series:
        step = max(1, int(2e6 / 21 / min(cfg.q + 1, 100 / cfg.log_b)))  # pairs whose terms fit in memory together
        parts = [jaccards_corrected(cfg, *(v.iloc[k : k + step] for v in (n1, n2, p, q, e, z))) for k in range(0, len(n1), step)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    solve.__annotations__ = {**{c: pd.Series for c in ("n1", "n2", "p", "q", "e", "z")}, "return": pd.Series}
    return F.pandas_udf(solve, "double")


def joint_new(cfg: Registers, compared: DataFrame, joint_range_correction: bool = False, incl_excl_fallback: bool = False) -> DataFrame:
    """(k1, k2, n1, n2, q) by likelihood; ``compared`` has n1 and n2, and for the fallback ``union``.

    Pairs with registers both untouched or both saturated are treated by the two
    options, which are off by default as in all published configurations: the
    correction takes those without saturated registers, the fallback to inclusion
    and exclusion those that are left.
    """
    if incl_excl_fallback and "union" not in compared.columns:
        raise ValueError("the fallback needs the column union")
    n1, n2 = F.col("n1"), F.col("n2")
    plain = jaccard_ml(cfg.b, n1, n2, F.col("d_plus"), F.col("d_minus"), F.col("d_equal"))
    extreme, saturated = (F.col("both_zero") > 0) | (F.col("both_top") > 0), F.col("both_top") > 0
    q = from_jaccard(n1, n2, plain)
    if incl_excl_fallback:
        q = F.when(extreme, from_union(n1, n2, F.col("union"))).otherwise(q)
    if joint_range_correction:
        # a pair that is not to be corrected goes without cardinalities, and so without a search
        sizes = [F.when(extreme & ~saturated, n) for n in (n1, n2)]
        corrected = _corrected_udf(cfg)(*sizes, *(F.col(c).cast("double") for c in ("d_plus", "d_minus", "d_equal", "both_zero")))
        q = F.when(extreme & ~saturated, from_jaccard(n1, n2, corrected)).otherwise(q)
    return compared.select(*PAIR, "n1", "n2", q.alias("q"))


def joint_incl_excl(compared: DataFrame) -> DataFrame:
    return compared.select(*PAIR, "n1", "n2", from_union(F.col("n1"), F.col("n2"), F.col("union")).alias("q"))


def p_inverse(b: float, p: Column) -> Column:
    """x with p_b(x) = p."""
    return -F.expm1(-p * math.log(b)) * b / (b - 1)


def joint_simple_deprecated(cfg: Registers, compared: DataFrame) -> DataFrame:
    alpha, beta = (p_inverse(cfg.b, F.col(c) / float(cfg.m)) for c in ("d_plus", "d_minus"))
    return compared.select(*PAIR, "n1", "n2", from_alpha_beta(F.col("n1"), F.col("n2"), alpha, beta).alias("q"))


def difference_slopes(b: float, share: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Derivative, by the probability that one register leads, of ln P(it leads by exactly ``lead``).

    ``share`` is that side's own share of the elements.  A register leads by at
    least l with probability log_b(b (s + r) / (s + b r)) for s = share b^(1 - l)
    and r = 1 - share; the sum over all levels is replaced by its integral.
    """
    rest, s = 1 - share, b ** (1.0 - lead)
    parts = [(share * s + rest * b**e, s - b**e) for e in (0, 1, 2)]
    chance = np.log1p(parts[1][0] ** -2 * share * s * rest * (b - 1) ** 2)
    slope = parts[0][1] / parts[0][0] - 2 * parts[1][1] / parts[1][0] + parts[2][1] / parts[2][0]
    leads = (b - 1) / (b - (b - 1) * share) / math.log(b)
    return slope / chance / leads


def shares_ml(cfg: Registers, leads: list[dict[int, int]], price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each histogram {lead: count}, the own share whose likelihood grows by ``price`` for each unit of leading probability, and that probability."""
    width = max((len(h) for h in leads), default=0) or 1
    lead, count = np.ones((len(leads), width)), np.zeros((len(leads), width))
    for row, h in enumerate(leads):
        lead[row, : len(h)], count[row, : len(h)] = list(h), list(h.values())
    some = count.sum(axis=1) > 0
    lo, hi = np.zeros(len(leads)), some.astype(float)
    for _ in range(60):
        mid = (lo + hi) / 2
        inside = np.where((mid > 0) & (mid < 1), mid, 0.5)
        up = (count * difference_slopes(cfg.b, inside[:, None], lead)).sum(axis=1) > price
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    share = np.where(some, (lo + hi) / 2, 0.0)
    return share, -np.log1p(-share * (cfg.b - 1) / cfg.b) / cfg.log_b


def own_shares(cfg: Registers, ahead: list[dict[int, int]], behind: list[dict[int, int]], equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own shares of both sides, of largest likelihood given by how much registers differ.

    Probabilities of leading, trailing and being equal sum to one; the price of
    that constraint is found by bisection, and each side follows from it alone.
    """
    lo, hi = np.log(np.maximum(equal, 1e-9)), np.full(len(equal), math.log(16.0 * cfg.m))
    for _ in range(60):
        price = np.exp((lo + hi) / 2)
        spent = shares_ml(cfg, ahead, price)[1] + shares_ml(cfg, behind, price)[1] + equal / price
        lo, hi = np.where(spent > 1, (lo + hi) / 2, lo), np.where(spent > 1, hi, (lo + hi) / 2)
    price = np.where(equal > 0, np.exp((lo + hi) / 2), 0.0)  # without equal registers each side stands alone
    return shares_ml(cfg, ahead, price)[0], shares_ml(cfg, behind, price)[0]


def _own_shares_udf(cfg: Registers):
    def solve(histogram: pd.Series, equal: pd.Series) -> pd.DataFrame:
        ahead = [{int(d["difference"]): d["c"] for d in h if d["difference"] > 0} for h in histogram]
        behind = [{-int(d["difference"]): d["c"] for d in h if d["difference"] < 0} for h in histogram]
        alpha, beta = own_shares(cfg, ahead, behind, equal.to_numpy(float))
        return pd.DataFrame({"alpha": alpha, "beta": beta})

    solve.__annotations__ = {"histogram": pd.Series, "equal": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(solve, "alpha double, beta double")


def joint_ml_deprecated(cfg: Registers, compared: DataFrame, differences: DataFrame) -> DataFrame:
    """alpha and beta of largest likelihood given ``differences``, a difference_histogram, without use of the cardinalities."""
    held = differences.groupBy(*PAIR).agg(F.collect_list(F.struct("difference", "c")).alias("histogram"))
    rows = compared.join(held, PAIR, "left").withColumn("histogram", F.coalesce("histogram", F.array().cast("array<struct<difference:bigint,c:bigint>>")))
    found = rows.select(*PAIR, "n1", "n2", _own_shares_udf(cfg)("histogram", F.col("d_equal").cast("double")).alias("own"))
    return found.select(*PAIR, "n1", "n2", from_alpha_beta(F.col("n1"), F.col("n2"), F.col("own.alpha"), F.col("own.beta")).alias("q"))


def bounds(b: float, m: int, compared: DataFrame) -> DataFrame:
    """(k1, k2, lower, upper) of the Jaccard similarity from equal registers alone."""
    share = F.col("d_equal") / float(m)
    return compared.select(*PAIR, jaccard_lower(b, share).alias("lower"), jaccard_upper(b, share).alias("upper"))


# ---- minimum hashes -------------------------------------------------------


def minhash_original(cfg: MinHash, compared: DataFrame) -> DataFrame:
    return compared.select(*PAIR, "n1", "n2", from_jaccard(F.col("n1"), F.col("n2"), F.col("d_equal") / float(cfg.m)).alias("q"))


def minhash_simple_deprecated(cfg: MinHash, compared: DataFrame) -> DataFrame:
    """A smaller minimum means an element of that set alone."""
    return compared.select(*PAIR, "n1", "n2", from_alpha_beta(F.col("n1"), F.col("n2"), F.col("d_minus") / float(cfg.m), F.col("d_plus") / float(cfg.m)).alias("q"))


def minhash_new(cfg: MinHash, compared: DataFrame) -> DataFrame:
    """Closed form of the likelihood's maximum."""
    n1, n2, plus, minus, equal = F.col("n1"), F.col("n2"), F.col("d_minus").cast("double"), F.col("d_plus").cast("double"), F.col("d_equal").cast("double")
    a, b = n1 * n1 * (equal + minus), n2 * n2 * (equal + plus)
    root = F.sqrt(F.pow(a - b, F.lit(2)) + 4 * plus * minus * n1 * n1 * n2 * n2)
    j = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(a + b - root, 2 * cfg.m * n1 * n2), F.lit(0.0))))
    return compared.select(*PAIR, "n1", "n2", from_jaccard(n1, n2, j).alias("q"))


# ---- HyperMinHash ---------------------------------------------------------

#: Fixed value of the published large-set collision formula.
COLLISIONS = 0.169919487159739093975315012348630288992889


def expected_collisions(cfg: HyperMinHash, n1: Column, n2: Column) -> Column:
    """Registers that two disjoint sets would share."""
    m, width, last = float(cfg.m), float(1 << cfg.sub_bits), 1 << cfg.bucket_size
    ratio = F.try_divide(F.greatest(n1, n2), F.least(n1, n2))
    large = F.coalesce(F.lit(COLLISIONS * m / width) * 4 * ratio / F.pow(1 + ratio, F.lit(2)), F.lit(0.0))

    def share(n: Column, i: Column) -> Column:
        low = F.when(i == last, 0.0).otherwise(F.pow(F.lit(2.0), -i) / m)
        return F.pow(1 - low, n) - F.pow(1 - F.pow(F.lit(2.0), 1 - i) / m, n)

    small = F.aggregate(F.sequence(F.lit(1), F.lit(last)), F.lit(0.0), lambda s, i: s + share(n1, i) * share(n2, i)) * m / width
    return F.when(F.greatest(n1, n2) > 32 * m, large).otherwise(small)


def hyperminhash_original_joint(cfg: HyperMinHash, compared: DataFrame) -> DataFrame:
    n1, n2 = F.col("n1"), F.col("n2")
    j = F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.col("matches") - expected_collisions(cfg, n1, n2)), F.col("filled").cast("double")), F.lit(0.0))
    return compared.select(*PAIR, "n1", "n2", from_jaccard(n1, n2, j).alias("q"))


def hyperminhash_as_ghll(cfg: HyperMinHash, sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("k", hyperminhash_to_ghll(cfg, F.col("k")))


def hyperminhash_as_hll(cfg: HyperMinHash, sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("k", hyperminhash_to_hll(cfg, F.col("k")))


# ---- all estimators of a family ------------------------------------------

families.joint_estimators.register(Registers, lambda cfg: {"new": joint_new})
families.joint_estimators.register(MinHash, lambda cfg: {"simpleDeprecated": minhash_simple_deprecated, "original": minhash_original, "new": minhash_new})
families.joint_estimators.register(HyperMinHash, lambda cfg: {"original": hyperminhash_original_joint, "new": lambda c, df: joint_new(c.as_ghll(), df)})
#: Labels that take no true cardinalities: it uses none, and these families have no such label.
ESTIMATED_ONLY = {"simpleDeprecated"}


def joint(cfg, sketches: DataFrame, key: str, wanted: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(k1, k2, estimator, q): every estimator of the family; ``known`` is (key, estimate) of true cardinalities.

    Sketches are built once, whatever the number of labels.
    """
    sketches = stored(sketches.select(key, "reg", "k"), "joint-sketches")
    estimate, base, fine = cardinality.own(cfg), pairs(cfg, sketches, key, wanted), {}
    if isinstance(cfg, HyperMinHash):
        # its likelihood counts how registers of the finer equivalent compare, its union is that of the coarser one
        fine = {"new": pairs(cfg.as_ghll(), hyperminhash_as_ghll(cfg, sketches), key, wanted)}
        union = union_estimate(cfg.as_hll(), hyperminhash_as_hll(cfg, sketches), key, wanted, cardinality.simple)
    else:
        union = union_estimate(cfg, sketches, key, wanted, estimate)
    makers = families.joint_estimators(cfg) | {"inclExcl": None}
    found = []
    for suffix, cards in (("", estimate(cfg, sketches, [key])), ("KnownCard", known)):
        for label, maker in makers.items():
            if cards is None or suffix and (label in ESTIMATED_ONLY or maker is None and isinstance(cfg, HyperMinHash)):
                continue
            compared = with_cardinalities(fine.get(label, base), cards, key)
            q = joint_incl_excl(compared.join(union, PAIR)) if maker is None else maker(cfg, compared)
            found.append(q.select(*PAIR, F.lit(label + suffix).alias("estimator"), "q"))
    return reduce(DataFrame.unionByName, found)
