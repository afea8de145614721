"""Further queries: likelihood estimates, label vectors, accuracy, randomness, result files; each with SQL that finds its values another way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.config import GeneralizedHyperLogLog, HyperLogLog, Registers
from setforge.functions import random, scalar
from setforge.operators import cardinality, joint, sketches
from setforge.plans import experiments
from setforge.plans.catalog import (
    GHLL2, HLL, HMH, MIN, ORACLE_SQL, PRIORITY_CUSTOMERS, SEGMENT_ORDERS, SET1, SET2, SUPPLIER_PARTS, _compared, _grid, _grid_sql, _hex, _rounded, _spread,
    compared_sql, key_pairs, larger_share, minhash_sql, priority_customers, quantities_sql, query, registers_sql, segment_orders, simple_sql, supplier_parts, table,
)
from setforge.sources import grids, results

# ---- likelihood of a cardinality: bisection on its derivative --------------


def ml_sql(registers: str, cfg: Registers, key: str = "key") -> str:
    """(key, estimate) where the derivative of the likelihood of all m registers is zero."""
    low, high = f"({cfg.rate!r}::DOUBLE * pow({cfg.b!r}::DOUBLE, -h.k))", f"({cfg.rate!r}::DOUBLE * pow({cfg.b!r}::DOUBLE, 1 - h.k))"
    inner = f"-{low} + ({high} - {low}) / (exp(least(700.0::DOUBLE, mid * ({high} - {low}))) - 1)"
    if cfg.range_correction:  # no register is below 0 or above q + 1
        last = f"{cfg.rate * cfg.b**-cfg.q!r}::DOUBLE"
        inner = f"CASE WHEN h.k = 0 THEN -{cfg.rate!r}::DOUBLE WHEN h.k > {cfg.q} THEN {last} / (exp(least(700.0::DOUBLE, mid * {last})) - 1) ELSE {inner} END"
    return f"""WITH RECURSIVE rg AS ({registers}),
hs AS (SELECT {key}, k, count(*) AS c FROM rg WHERE k > 0 GROUP BY {key}, k UNION ALL SELECT {key}, 0, {cfg.m} - count(*) FROM rg WHERE k > 0 GROUP BY {key} HAVING count(*) < {cfg.m}),
ls AS (SELECT {key}, list({{'k': k, 'c': c}}) AS hist FROM hs GROUP BY {key}),
bis AS (SELECT {key}, hist, 0 AS step, 0::DOUBLE AS lo, 1e8::DOUBLE AS hi FROM ls
 UNION ALL SELECT {key}, hist, step + 1, CASE WHEN slope > 0 THEN mid ELSE lo END, CASE WHEN slope > 0 THEN hi ELSE mid END
 FROM (SELECT *, list_sum(list_transform(hist, lambda h: h.c * ({inner}))) AS slope FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE step < 90)))
SELECT {key}, (lo + hi) / 2 AS estimate FROM bis WHERE step = 90"""


for _name, _cfg in (("hll", HLL), ("ghll", GHLL2), ("setsketch1", SET1), ("setsketch2", SET2)):
    query(f"{_name}_cardinality_ml", f"SELECT key, round(estimate, 4) AS estimate FROM ({ml_sql(registers_sql(SEGMENT_ORDERS, _cfg), _cfg)})")(
        lambda s, d, c=_cfg: _rounded(cardinality.ml(c, sketches.build(c, segment_orders(s, d), "x", ["key"]), ["key"]))
    )
_BOTH = f"SELECT key, 'simple' AS estimator, round(estimate, 4) AS estimate FROM ({simple_sql(registers_sql(SUPPLIER_PARTS, GHLL2), GHLL2)}) UNION ALL SELECT key, 'ml', round(estimate, 4) FROM ({ml_sql(registers_sql(SUPPLIER_PARTS, GHLL2), GHLL2)})"
query("cardinality_labels", _BOTH)(lambda s, d: _rounded(cardinality.estimates(GHLL2, sketches.build(GHLL2, supplier_parts(s, d), "x", ["key"]), ["key"]), 4, ("key", "estimator")))
_MIN_ESTIMATES = minhash_sql(registers_sql(SEGMENT_ORDERS, MIN))
query("minhash_labels", f"SELECT key, unnest(['simple', 'ml']) AS estimator, round(estimate, 4) AS estimate FROM ({_MIN_ESTIMATES})")(
    lambda s, d: _rounded(cardinality.estimates(MIN, sketches.build(MIN, segment_orders(s, d), "x", ["key"]), ["key"]), 4, ("key", "estimator"))
)


# ---- joint quantities: ternary search -------------------------------------


def _log(count: str, x: str) -> str:
    return f"CASE WHEN {count} = 0 THEN 0 ELSE {count} * ln(greatest({x}, 1e-300)) END"


def plain_likelihood(b: float):
    def at(j: str) -> str:
        p, q = (larger_share(x, b) for x in (f"greatest(0, n1 - n2 * {j}) / (n1 + n2)", f"greatest(0, n2 - n1 * {j}) / (n1 + n2)"))
        return f"({_log('d_plus', p)} + {_log('d_minus', q)} + {_log('d_equal', f'1 - {p} - {q}')})"

    return at


def corrected_likelihood(cfg: Registers):
    """With registers that both sketches left untouched told from others that are equal."""

    def at(j: str) -> str:
        whole = f"({cfg.rate!r}::DOUBLE * (n1 + n2) / (1 + {j}))"

        def share(own: str, other: str) -> str:
            low = f"({cfg.rate!r}::DOUBLE * (greatest(0, {own} - {other} * {j}) / ({cfg.b!r} * (1 + {j})) + {other}))"
            return f"list_sum(list_transform(range(0, {cfg.q + 1}), lambda k: exp(-{low} * pow({cfg.b!r}::DOUBLE, -k)) - exp(-{whole} * pow({cfg.b!r}::DOUBLE, -k))))"

        p, q = share("n1", "n2"), share("n2", "n1")
        return f"(-{whole} * both_zero + {_log('d_plus', p)} + {_log('d_minus', q)} + {_log('(d_equal - both_zero)', f'1 - {p} - {q} - exp(-{whole})')})"

    return at


def ternary_sql(likelihood, source: str, name: str = "found", steps: int = 70) -> str:
    """CTEs up to ``name``: the columns of ``source`` with jm, where the likelihood is largest."""
    return f"""t_{name} AS (SELECT *, 0 AS step, 0::DOUBLE AS lo, least(n1 / n2, n2 / n1) AS hi FROM {source}
 UNION ALL SELECT * EXCLUDE (step, lo, hi, x1, x2, keep), step + 1, CASE WHEN keep THEN lo ELSE x1 END, CASE WHEN keep THEN x2 ELSE hi END
 FROM (SELECT *, {likelihood('x1')} >= {likelihood('x2')} AS keep FROM (SELECT *, lo + (hi - lo) / 3 AS x1, hi - (hi - lo) / 3 AS x2 FROM t_{name} WHERE step < {steps}))),
{name} AS (SELECT * EXCLUDE (step, lo, hi), (lo + hi) / 2 AS jm FROM t_{name} WHERE step = {steps})"""


_R = "SELECT * FROM r"
_PAIRS = compared_sql(GHLL2, simple_sql(_R, GHLL2))
_MERGED = "merged AS (SELECT a.key || '~' || b.key AS key, a.reg, greatest(a.k, b.k) AS k FROM full_regs a JOIN full_regs b ON a.reg = b.reg AND a.key < b.key)"
_CLIP = "greatest(0, least({0}, n1 / n2, n2 / n1))"

query("joint_new_ml", f"WITH RECURSIVE {_PAIRS}, {ternary_sql(plain_likelihood(GHLL2.b), 'p')}, {quantities_sql('jm', 'found', 2)}")(lambda s, d: _spread(joint.joint_new(GHLL2, _compared(GHLL2, s, d, cardinality.simple)[2]), 2))


def leading_slope_sql(histogram: str, share: str, b: float) -> str:
    """Derivative of the likelihood of leads by the probability of leading, at a side's own share of the elements."""
    s, r = f"({share} * pow({b!r}::DOUBLE, 1 - h.lead))", f"(1 - {share})"
    f0, f1, f2 = (f"({s} + {r} * {b**e!r}::DOUBLE)" for e in (0, 1, 2))
    g0, g1, g2 = (f"(pow({b!r}::DOUBLE, 1 - h.lead) - {b**e!r}::DOUBLE)" for e in (0, 1, 2))
    each = f"({g0} / {f0} - 2 * {g1} / {f1} + {g2} / {f2}) / ln({f0} * {f2} / ({f1} * {f1}))"
    return f"(coalesce(list_sum(list_transform({histogram}, lambda h: h.c * {each})), 0) * (1 - {share} * {(b - 1) / b!r}::DOUBLE) * ln({b!r}::DOUBLE) / {(b - 1) / b!r}::DOUBLE)"


def own_share_sql(name: str, own: str, other: str, b: float) -> str:
    """CTEs up to ``name``: (k1, k2, share) by bisection; at each share of one side the constraint gives the other's."""
    leads, log_b = f"(-ln(1 - mid * {(b - 1) / b!r}::DOUBLE) / ln({b!r}::DOUBLE))", f"ln({b!r}::DOUBLE)"
    return f"""b_{name} AS (SELECT k1, k2, d_equal, {own} AS own, {other} AS other, 0 AS step, 0::DOUBLE AS lo, 1::DOUBLE AS hi FROM hs
 UNION ALL SELECT k1, k2, d_equal, own, other, step + 1, CASE WHEN high THEN lo ELSE mid END, CASE WHEN high THEN mid ELSE hi END
 FROM (SELECT *, CASE WHEN d_equal = 0 THEN slope < 0 WHEN len(other) = 0 THEN slope < d_equal / (1 - {leads}) WHEN slope <= 0 OR left_over <= 0 THEN true
   ELSE {leading_slope_sql('other', f'((1 - pow({b!r}::DOUBLE, -left_over)) * {b / (b - 1)!r}::DOUBLE)', b)} > slope END AS high
  FROM (SELECT *, 1 - {leads} - d_equal / nullif(slope, 0) AS left_over
   FROM (SELECT *, {leading_slope_sql('own', 'mid', b)} AS slope FROM (SELECT *, (lo + hi) / 2 AS mid FROM b_{name} WHERE step < 50))))),
{name} AS (SELECT k1, k2, CASE WHEN len(own) = 0 THEN 0 ELSE (lo + hi) / 2 END AS share FROM b_{name} WHERE step = 50)"""


_HISTOGRAMS = """dh AS (SELECT a.key AS k1, b.key AS k2, a.k - b.k AS d, count(*) AS c FROM full_regs a JOIN full_regs b ON a.reg = b.reg AND a.key < b.key GROUP BY ALL),
hs AS (SELECT k1, k2, coalesce(sum(c) FILTER (d = 0), 0) AS d_equal, coalesce(list({'lead': d, 'c': c}) FILTER (d > 0), []) AS ahead, coalesce(list({'lead': -d, 'c': c}) FILTER (d < 0), []) AS behind FROM dh GROUP BY k1, k2)"""


@query(
    "joint_ml_deprecated",
    f"WITH RECURSIVE {_PAIRS}, {_HISTOGRAMS}, {own_share_sql('sa', 'ahead', 'behind', GHLL2.b)}, {own_share_sql('sb', 'behind', 'ahead', GHLL2.b)}, "
    f"ps AS (SELECT p.*, sa.share AS own1, sb.share AS own2 FROM p JOIN sa USING (k1, k2) JOIN sb USING (k1, k2)), {quantities_sql('greatest(0, 1 - own1 - own2)', 'ps', 2)}",
)
def joint_ml_deprecated(spark: SparkSession, sf: str) -> DataFrame:
    regs, wanted, compared = _compared(GHLL2, spark, sf, cardinality.simple)
    return _spread(joint.joint_ml_deprecated(GHLL2, compared, joint.difference_histogram(regs, "key", wanted)), 2)


# few elements a set, so that many registers stay untouched
_FEW = "SELECT o_orderpriority AS key, o_custkey AS x FROM orders WHERE o_totalprice > 300000"
_FEW_PAIRS = compared_sql(GHLL2, simple_sql(_R, GHLL2), _FEW)


def _few(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of large orders; the price is the feature, not a sample."""
    elements = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("x"))
    regs, wanted = sketches.build(GHLL2, elements, "x", ["key"]), key_pairs(elements)
    return joint.with_cardinalities(joint.pairs(GHLL2, regs, "key", wanted), cardinality.simple(GHLL2, regs, ["key"]), "key")


query(
    "joint_new_corrected",
    f"WITH RECURSIVE {_FEW_PAIRS}, z AS (SELECT *, {GHLL2.m} - filled AS both_zero FROM p), {ternary_sql(corrected_likelihood(GHLL2), 'z', steps=60)} SELECT k1, k2, round(jm, 5) AS jaccard FROM found WHERE both_zero > 0",
)(lambda s, d: joint.joint_new(GHLL2, _few(s, d).where("both_zero > 0"), joint_range_correction=True).select("k1", "k2", F.round("q.jaccard", 5).alias("jaccard")))

_KNOWN = f"SELECT key, count(DISTINCT x)::DOUBLE AS estimate FROM ({PRIORITY_CUSTOMERS}) GROUP BY key"
_LABELS = (
    f"WITH RECURSIVE {_PAIRS}, kc AS ({_KNOWN}), {_MERGED}, un AS ({simple_sql('SELECT * FROM merged', GHLL2)}), "
    "both_cards AS (SELECT '' AS suffix, p.* FROM p UNION ALL SELECT 'KnownCard', p.* REPLACE (a.estimate AS n1, b.estimate AS n2) FROM p JOIN kc a ON a.key = k1 JOIN kc b ON b.key = k2), "
    + ternary_sql(plain_likelihood(GHLL2.b), "both_cards")
    + f" SELECT k1, k2, 'new' || suffix AS estimator, round(jm, 4) AS jaccard FROM found UNION ALL SELECT k1, k2, 'inclExcl' || suffix, round({_CLIP.format('(n1 + n2 - estimate) / estimate')}, 4) FROM both_cards JOIN un ON un.key = k1 || '~' || k2"
)


@query("joint_labels", _LABELS)
def joint_labels(spark: SparkSession, sf: str) -> DataFrame:
    elements = priority_customers(spark, sf)
    known = elements.groupBy("key").agg(F.countDistinct("x").cast("double").alias("estimate"))
    return _jaccards(joint.joint(GHLL2, sketches.build(GHLL2, elements, "x", ["key"]), "key", key_pairs(elements), known))


def _jaccards(found: DataFrame, digits: int = 4) -> DataFrame:
    return found.select("k1", "k2", "estimator", F.round("q.jaccard", digits).alias("jaccard"))


_MIN_PAIRS = compared_sql(MIN, minhash_sql(_R))
_MIN_MERGED = "merged AS (SELECT a.key || '~' || b.key AS key, a.reg, least(a.k, b.k) AS k FROM full_regs a JOIN full_regs b ON a.reg = b.reg AND a.key < b.key)"
_MIN_FORMS = {
    "original": f"d_equal / {MIN.m}::DOUBLE",
    "simpleDeprecated": f"greatest(0, 1 - d_minus / {MIN.m}::DOUBLE - d_plus / {MIN.m}::DOUBLE)",
    "new": f"greatest(0, (a + b - sqrt(pow(a - b, 2) + 4.0 * d_plus * d_minus * n1 * n1 * n2 * n2)) / (2.0 * {MIN.m} * n1 * n2))",
    "inclExcl": "(n1 + n2 - nu) / nu",
}
query(
    "joint_minhash_labels",
    f"WITH {_MIN_PAIRS}, {_MIN_MERGED}, un AS ({minhash_sql('SELECT * FROM merged')}), ab AS (SELECT p.*, n1 * n1 * (d_equal + d_plus) AS a, n2 * n2 * (d_equal + d_minus) AS b, un.estimate AS nu FROM p JOIN un ON un.key = k1 || '~' || k2) "
    + " UNION ALL ".join(f"SELECT k1, k2, '{n}' AS estimator, round({_CLIP.format(f)}, 7) AS jaccard FROM ab" for n, f in _MIN_FORMS.items()),
)(lambda s, d: _jaccards(joint.joint(MIN, sketches.build(MIN, e := priority_customers(s, d), "x", ["key"]), "key", key_pairs(e)), 7))

_HMH_PAIRS = compared_sql(HMH, simple_sql(f"SELECT key, reg, k >> {HMH.sub_bits} AS k FROM r", HMH.as_hll()))
_SHARE = lambda n: f"(pow(1 - (CASE WHEN i = {1 << HMH.bucket_size} THEN 0 ELSE pow(2.0::DOUBLE, -i) / {HMH.m} END), {n}) - pow(1 - pow(2.0::DOUBLE, 1 - i) / {HMH.m}, {n}))"
query(
    "joint_hyperminhash_all",
    f"WITH RECURSIVE {_HMH_PAIRS}, merged AS (SELECT a.key || '~' || b.key AS key, a.reg, greatest(a.k, b.k) >> {HMH.sub_bits} AS k FROM full_regs a JOIN full_regs b ON a.reg = b.reg AND a.key < b.key WHERE a.k > 0 OR b.k > 0), "
    f"un AS ({simple_sql('SELECT * FROM merged', HMH.as_hll())}), "
    f"cp AS (SELECT k1, k2, sum({_SHARE('n1')} * {_SHARE('n2')}) * {HMH.m} / {float(1 << HMH.sub_bits)!r}::DOUBLE AS expected FROM p, range(1, {(1 << HMH.bucket_size) + 1}) t(i) GROUP BY k1, k2), "
    + ternary_sql(plain_likelihood(HMH.effective_base), "p")
    + f""" SELECT k1, k2, 'new' AS estimator, round(jm, 4) AS jaccard FROM found
UNION ALL SELECT k1, k2, 'original', round({_CLIP.format('greatest(0, matches - expected) / filled')}, 4) FROM p JOIN cp USING (k1, k2)
UNION ALL SELECT k1, k2, 'inclExcl', round({_CLIP.format('(n1 + n2 - estimate) / estimate')}, 4) FROM p JOIN un ON un.key = k1 || '~' || k2""",
)(lambda s, d: _jaccards(joint.joint(HMH, sketches.build(HMH, e := priority_customers(s, d), "x", ["key"]), "key", key_pairs(e))))

_SIZES = {"d1": (0.0, 3.0, 100.0), "d2": (1.0, 50.0), "i": (0.0, 4.0, 1000.0)}
query(
    "derived_quantities",
    f"""SELECT d1, d2, i, round(d1 + i, 9) AS cardinality1, round(d2 + i, 9) AS cardinality2, round(d1 + d2 + i, 9) AS "union", round(i / (d1 + d2 + i), 9) AS jaccard,
round(CASE WHEN i = 0 THEN 0 ELSE i / sqrt((d1 + i) * (d2 + i)) END, 9) AS cosine, round(CASE WHEN i = 0 THEN 0 ELSE i / (d1 + i) END, 9) AS inclusion1, round(i / (d2 + i), 9) AS inclusion2,
round(d1 / (d1 + d2 + i), 9) AS alpha, round(d2 / (d1 + d2 + i), 9) AS beta FROM ({_grid_sql(**_SIZES)})""",
)(lambda s, d: _grid(s, **_SIZES).select("d1", "d2", "i", joint.derived(F.col("d1"), F.col("d2"), F.col("i")).alias("q")).select("d1", "d2", "i", *(F.round(f"q.{c}", 9).alias(c) for c in joint.QUANTITIES[3:])))


@query("merge_two_registers", registers_sql(SEGMENT_ORDERS, GHLL2))
def merge_two_registers(spark: SparkSession, sf: str) -> DataFrame:
    """Two sketch tables of one configuration, checked and merged."""
    elements = segment_orders(spark, sf).withColumn("odd", F.col("x") % 2 == 1)
    one, two = (sketches.build(GHLL2, elements.where(c).drop("odd"), "x", ["key"]) for c in ("odd", "NOT odd"))
    return sketches.merge_two(GHLL2, one, GHLL2, two, ["key"])


# ---- accuracy over many examples -------------------------------------------

_CARDS, _EXAMPLES = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000), 100


def accuracy_sql(cfg: Registers, label: str) -> str:
    source = f"SELECT (example::VARCHAR || '~' || c::VARCHAR) AS key, '1|' || example::VARCHAR || '|' || i::VARCHAR AS x FROM range({_EXAMPLES}) e(example), (SELECT unnest([{', '.join(map(str, _CARDS))}]) AS c), LATERAL (SELECT unnest(range(c)) AS i)"
    found = simple_sql(registers_sql(source, cfg), cfg) if label == "simple" else ml_sql(registers_sql(source, cfg), cfg)
    own = f"SELECT split_part(key, '~', 2)::BIGINT AS cardinality, estimate FROM ({found})"
    return f"SELECT cardinality, '{label}' AS estimator, round(avg(estimate), 4) AS mean, round(avg(pow(estimate - cardinality, 2)), 3) AS mse, round(stddev_pop(estimate), 4) AS std FROM ({own}) GROUP BY cardinality"


for _name, _cfg in (("ghll", GeneralizedHyperLogLog(64, scheme="md5")), ("hll", HyperLogLog(64, 2.0, 58, scheme="md5"))):
    query(f"{_name}_accuracy", f"({accuracy_sql(_cfg, 'simple')}) UNION ALL ({accuracy_sql(_cfg, 'ml')})")(
        lambda s, d, c=_cfg: experiments.cardinality_accuracy(s, c, _EXAMPLES, list(_CARDS), scheme="md5").select("cardinality", "estimator", F.round("mean", 4).alias("mean"), F.round("mse", 3).alias("mse"), F.round("std", 4).alias("std"))
    )


# ---- theory ----------------------------------------------------------------

query("effective_base", f"SELECT r, round(pow(2.0::DOUBLE, pow(2.0::DOUBLE, -r)), 12) AS b, round((r - 3.0::DOUBLE) / 3, 12) AS error FROM ({_grid_sql(r=(0, 1, 4, 10, 20))})")(
    lambda s, d: _grid(s, r=(0, 1, 4, 10, 20)).select("r", F.round(scalar.effective_base(F.col("r")), 12).alias("b"), F.round(scalar.relative_error(F.col("r"), F.lit(3.0)), 12).alias("error"))
)
_J = (0.05, 0.1, 0.5, 0.9)
query("minhash_errors", f"SELECT j, m, round(sqrt(j * (1 - j) / m) / j, 9) AS rmse FROM ({_grid_sql(j=_J, m=(64, 4096))})")(
    lambda s, d: _grid(s, j=_J, m=(64, 4096)).select("j", "m", F.round(scalar.minhash_relative_rmse(F.col("j"), F.col("m")), 9).alias("rmse"))
)
# the estimate is (b^D - 1) / (b - 1) cut at nothing, D the share of 64 registers that are equal: its mean square error by the binomial law of D
query(
    "upper_bound_errors",
    f"""WITH RECURSIVE g AS (SELECT j, ln(1 + j * (2.0 - 1) + pow(1 - j, 2) * pow(2.0 - 1, 2) / (4 * 2.0)) / ln(2.0) AS p FROM ({_grid_sql(j=_J)})),
w AS (SELECT j, p, 0 AS c, pow(1 - p, 64) AS mass FROM g UNION ALL SELECT j, p, c + 1, mass * (64 - c) / (c + 1) * p / (1 - p) FROM w WHERE c < 64)
SELECT j, round(sum(mass * pow(pow(2.0::DOUBLE, c / 64.0) - 1 - j, 2)), 9) AS mse FROM w GROUP BY j""",
)(lambda s, d: _grid(s, j=_J).select("j", F.round(scalar.upper_bound_mse(2.0, 64, F.col("j")), 9).alias("mse")))


# ---- randomness ------------------------------------------------------------

_X = "o_orderkey::VARCHAR || '|0'"
_U = f"(({_hex(_X, 1, 13)} + 0.5::DOUBLE) / {float(16**13)!r}::DOUBLE)"
_INT = lambda n: f"({_hex(_X, 1, 1)} >> {4 - (n.bit_length() - 1)})" if n & (n - 1) == 0 else f"floor({_U} * {n})::BIGINT"
_DRAWS = {
    "uniform": (_U, "v"), "uniform_half": (f"({_U} / 2)", "v * 2"), "exponential": (f"(-ln({_U}))", "1 - exp(-v)"),
    **{f"bernoulli_{p}": (f"({_U} < {p!r})::INT", p) for p in (0.1, 0.5, 0.9)}, **{f"bernoulli_{a}_{b}": (f"({_INT(b)} < {a})::INT", a / b) for a, b in ((1, 3), (5, 7))},
    **{f"uniform_int_{n}": (_INT(n), n) for n in (2, 3, 5, 6, 7, 8, 11, 12, 16)},
    **{f"truncated_exponential_{r}": (f"(-ln(1 + {_U} * (exp(-{r!r}::DOUBLE) - 1)) / {r!r}::DOUBLE)", f"(1 - exp(-v * {r!r}::DOUBLE)) / (1 - exp(-{r!r}::DOUBLE))") for r in (0.1, 0.5, 1.0, 2.0)},
    "one_bit": (f"(({_hex(_X, 1, 15)} >> 59) & 1)", 0.5),
}


def _statistic(name: str) -> str:
    draw, law = _DRAWS[name]
    rows = f"(SELECT {draw} AS v FROM orders)"
    if isinstance(law, str):
        body = f"SELECT max(n)::BIGINT AS n, max(greatest(i / n::DOUBLE - p, p - (i - 1) / n::DOUBLE)) AS statistic FROM (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM (SELECT {law} AS p FROM {rows}))"
    elif isinstance(law, int):
        body = f"SELECT sum(c)::BIGINT AS n, sum(c * c) * {law}.0 / sum(c) - sum(c) AS statistic FROM (SELECT v, count(*) AS c FROM {rows} GROUP BY v)"
    else:
        body = f"SELECT count(*) AS n, (sum(v) - count(*) * {law!r}::DOUBLE) / sqrt(count(*) * {law!r}::DOUBLE * (1 - {law!r}::DOUBLE)) AS statistic FROM {rows}"
    return f"SELECT '{name}' AS generator, 0 AS step, n, round(statistic, 6) AS statistic FROM ({body})"


query("rng_quality", " UNION ALL ".join(map(_statistic, _DRAWS)))(lambda s, d: experiments.rng_quality(table(s, d, "orders"), "o_orderkey").withColumn("statistic", F.round("statistic", 6)))
query("rng_draws", "SELECT o_orderkey, " + ", ".join(f'round({draw}, 9)::DOUBLE AS "{name}"' for name, (draw, _) in _DRAWS.items()) + ", floor(log2(o_orderkey + 1))::BIGINT AS log2_floor FROM orders")(
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey",
        *(F.round(draw("md5", F.col("o_orderkey"), 0).cast("double"), 9).alias(name) for name, (draw, _, _, _) in random.GENERATORS.items()),
        random.log2_floor(F.col("o_orderkey") + 1).cast("bigint").alias("log2_floor"),
    )
)
query(
    "rng_permutation",
    f"SELECT o_orderkey, item::INT AS item, (row_number() OVER (PARTITION BY o_orderkey ORDER BY {_hex("o_orderkey::VARCHAR || '|' || item::VARCHAR", 1, 15)}, item) - 1)::INT AS place FROM orders, range(5) t(item)",
)(lambda s, d: random.permutation(table(s, d, "orders").select("o_orderkey"), "md5", "o_orderkey", "item", 5))


# ---- result files -----------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """Where executors and driver both write; a temporary folder serves a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='setforge-')}/results-{uuid.uuid4().hex}"


_TYPES = "SELECT event_type, count(*)::DOUBLE AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low FROM events GROUP BY event_type"


@query("result_round_trip", f"SELECT '4.5' AS base, 'quick' AS mark, (row_number() OVER (ORDER BY event_type) - 1)::INT AS row, n, mean, low FROM ({_TYPES})")
def result_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A result file with metadata (a key without a value among it), found by a glob and read again."""
    found = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"))
    folder = _folder(spark)
    results.write(found.orderBy("event_type").select("n", "mean", "low", F.row_number().over(_by_type()).alias("at")), f"{folder}/one", {"base": "4.5", "quick": ""}, ["at"])
    cells = results.read(spark, f"{folder}/*/part-*")
    rows = results.wide(cells, ["n", "mean", "low"])
    info = F.from_json("info", "map<string,string>")
    return rows.select(info["base"].alias("base"), F.when(info["quick"] == "", "quick").alias("mark"), "row", "n", "mean", "low")


def _by_type():
    from pyspark.sql import Window

    return Window.orderBy("event_type")


@query("result_selection", "SELECT event_type, round(avg(value), 6) AS mean FROM events WHERE value > 50 GROUP BY event_type")
def result_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Of result files with different configurations, the rows of one."""
    kinds, events = {}, table(spark, sf, "events")
    folder = _folder(spark)
    for least in ("0", "50"):
        found = events.where(F.col("value") > int(least)).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
        found = found.withColumn("at", F.row_number().over(_by_type()))
        kinds[least] = found.select("at", "event_type")
        results.write(found.select("at", "mean"), f"{folder}/above-{least}", {"least": least, "mode": "mean"}, ["at"])
    rows = results.wide(results.of_config(results.read(spark, f"{folder}/*/part-*"), least="50", mode="mean"), ["at", "mean"])
    return rows.withColumn("at", F.col("at").cast("int")).join(kinds["50"], "at").select("event_type", "mean")


@query("number_lines", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem")
def number_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_folder(spark)}/numbers"
    results.write_numbers(table(spark, sf, "lineitem"), "l_extendedprice", path)
    return results.read_numbers(spark, path).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


# ---- sources ----------------------------------------------------------------

query("grid_maxima", f"SELECT max(diff1) AS diff1, max(diff2) AS diff2, max(intersection) AS intersection FROM ({ORACLE_SQL['set_triples']})")(lambda s, d: grids.maxima(grids.triples_frame(s)))


@query("same_data_two_sketches", f"SELECT 'hll' AS sketch, * FROM ({registers_sql(SEGMENT_ORDERS, HLL)}) UNION ALL SELECT 'ghll', * FROM ({registers_sql(SEGMENT_ORDERS, GHLL2)})")
def same_data_two_sketches(spark: SparkSession, sf: str) -> DataFrame:
    hll, ghll = grids.both_ways(segment_orders(spark, sf), *(lambda rows, c=c: sketches.build(c, rows, "x", ["key"]) for c in (HLL, GHLL2)))
    return hll.withColumn("sketch", F.lit("hll")).unionByName(ghll.withColumn("sketch", F.lit("ghll")))
