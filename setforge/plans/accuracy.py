"""Accuracy on the given tables: estimates on a grid of sizes against exact counts, and what theory expects of these very sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.config import GeneralizedHyperLogLog, SetSketch1
from setforge.functions import scalar
from setforge.operators import cardinality, joint, scan, sketches, stats
from setforge.plans import experiments
from setforge.plans.catalog import GHLL2, SEGMENT_ORDERS, SET1, SUPPLIER_PARTS, priority_customers, query, registers_sql, segment_orders, simple_sql, supplier_parts, table
from setforge.plans.more import ml_sql
from setforge.sources import grids
from setforge.sources.stored import stored

# ---- a grid of sizes ------------------------------------------------------------

GRID = grids.one_two_five(1_000_000_000)
GRID_CONFIGS = {"ghll": GeneralizedHyperLogLog(64, 2.0, 62, scheme="md5"), "setsketch1": SetSketch1(32, 2.0, 62, 20.0, scheme="md5")}
_NUMBERED = "SELECT l_suppkey AS example, l_partkey AS element, row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_orderkey), l_partkey) AS i FROM lineitem GROUP BY 1, 2"


def accuracy_sql(cfg) -> str:
    """Every prefix of a supplier's parts whose size is on the grid, sketched from its own elements."""
    source = f"SELECT example || '~' || c AS key, element AS x FROM ({_NUMBERED}) n JOIN (SELECT unnest([{', '.join(map(str, GRID))}]) AS c) g ON i <= c JOIN (SELECT example AS e, max(i) AS most FROM ({_NUMBERED}) GROUP BY 1) s ON s.e = example AND c <= most"
    expected = math.sqrt(((cfg.b + 1) / (cfg.b - 1) * math.log(cfg.b) - 1) / cfg.m)
    parts = [
        f"SELECT c AS cardinality, '{label}' AS estimator, count(*) AS examples, round(avg(estimate) / c - 1, 6) AS bias, round(sqrt(avg(pow(estimate - c, 2))) / c, 6) AS rmse, round({expected!r}::DOUBLE, 6) AS expected FROM (SELECT split_part(key, '~', 2)::BIGINT AS c, estimate FROM ({found})) GROUP BY c"
        for label, found in (("simple", simple_sql(registers_sql(source, cfg), cfg)), ("ml", ml_sql(registers_sql(source, cfg), cfg)))
    ]
    return " UNION ALL ".join(f"({p})" for p in parts)


def accuracy_on_grid(cfg, elements: DataFrame, examples: str, element: str, order: str) -> DataFrame:
    """(cardinality, estimator, examples, bias, rmse, expected): each example's distinct elements in order of their first row, estimated at every size of the grid it reaches."""
    first = elements.groupBy(F.col(examples).alias("example"), F.col(element).alias("element")).agg(F.min(order).alias("at"))
    streams = scan.numbered(first, ["example"], ["at", "element"], "number", "most").withColumn("i", F.col("number") - 1)
    streams = stored(streams, "grid-streams")
    # only the sizes that an example reaches, and once for all estimators
    registers = stored(experiments.running_registers(cfg, streams, GRID, streams.select("example", "most").distinct()), "grid-registers")
    found = cardinality.estimates(cfg, registers, ["example", "cardinality"])
    n = F.col("cardinality")
    grouped = found.groupBy("cardinality", "estimator").agg(F.count(F.lit(1)).alias("examples"), stats.mean(F.col("estimate")).alias("mean"), stats.mse(F.col("estimate"), n).alias("mse"))
    return grouped.select("cardinality", "estimator", "examples", scalar.relative_error(F.col("mean"), n).alias("bias"), (F.sqrt("mse") / n).alias("rmse"), scalar.expected_rsd(cfg.b, cfg.m).alias("expected"))


for _name, _cfg in GRID_CONFIGS.items():
    query(f"accuracy_on_grid_{_name}", accuracy_sql(_cfg))(
        lambda s, d, c=_cfg: accuracy_on_grid(c, table(s, d, "lineitem"), "l_suppkey", "l_partkey", "l_orderkey").select("cardinality", "estimator", "examples", *(F.round(x, 6).alias(x) for x in ("bias", "rmse", "expected")))
    )


# ---- what theory expects of these sets ---------------------------------------------

_BASES, _M = (1.001, 2.0), 256
_PAIR_SETS = """s AS (SELECT DISTINCT o_orderpriority AS key, o_custkey AS x FROM orders), n AS (SELECT key, count(*)::DOUBLE AS n FROM s GROUP BY key),
e AS (SELECT a.key AS k1, b.key AS k2, count(*)::DOUBLE AS i FROM s a JOIN s b ON a.x = b.x AND a.key < b.key GROUP BY 1, 2),
p AS (SELECT k1, k2, b, c.n + d.n - i AS total, i / (c.n + d.n - i) AS j, c.n / (c.n + d.n) AS u FROM e JOIN n c ON c.key = k1 JOIN n d ON d.key = k2, (SELECT unnest([1.001::DOUBLE, 2.0::DOUBLE]) AS b))"""
_THEORY = f"""WITH RECURSIVE {_PAIR_SETS},
q AS (SELECT *, u - (1 - u) * j AS x, (1 - u) - u * j AS y, ln(1 + j * (b - 1)) / ln(b) AS lower_p, ln(1 + j * (b - 1) + pow(1 - j, 2) * pow(b - 1, 2) / (4 * b)) / ln(b) AS upper_p FROM p),
r AS (SELECT *, -ln(1 - x * (b - 1) / b) / ln(b) AS px, -ln(1 - y * (b - 1) / b) / ln(b) AS py, (b - 1) / (b * ln(b)) AS f FROM q),
f AS (SELECT *, f * f * (pow((1 - u) * pow(b, px), 2) / px + pow(u * pow(b, py), 2) / py + pow((1 - u) * pow(b, px) + u * pow(b, py), 2) / (1 - px - py)) AS info FROM r),
w AS (SELECT k1, k2, b, j, upper_p AS p, 0 AS c, {_M} * ln(1 - upper_p) AS mass FROM q UNION ALL SELECT k1, k2, b, j, p, c + 1, mass + ln(({_M} - c) / (c + 1.0::DOUBLE)) + ln(p) - ln(1 - p) FROM w WHERE c < {_M}),
ub AS (SELECT k1, k2, b, sum(exp(mass) * pow((pow(b, c / {float(_M)}) - 1) / (b - 1) - j, 2)) AS mse FROM w GROUP BY k1, k2, b)
SELECT k1, k2, b, round(j, 9) AS jaccard, round(lower_p, 7) AS lower_p, round(upper_p, 7) AS upper_p, round(greatest(0, 2 * (pow(b, (lower_p + 1) / 2) - 1) / (b - 1) - 1), 6) AS lower_j, round((pow(b, upper_p) - 1) / (b - 1), 6) AS upper_j, round(px, 7) AS leads,
round(sqrt(j * (1 - j) / {_M}) / j, 7) AS minhash_rmse, round(1 / sqrt({_M} * info) / j, 6) AS jaccard_rse, round(1 / sqrt({_M} * info) / x / (1 + j), 6) AS difference_rse,
round(1 / sqrt({_M} * info) / j / (1 + j), 6) AS intersection_rse, round(1 / sqrt(info * j * (1 - j)), 6) AS against_minhash, round(mse, 7) AS upper_bound_mse FROM f JOIN ub USING (k1, k2, b)"""


@query("pair_theory", _THEORY)
def pair_theory(spark: SparkSession, sf: str) -> DataFrame:
    """Collision probabilities, bounds and standard errors for the customers of any two priorities, from their exact overlap."""
    sets = priority_customers(spark, sf).distinct()
    sizes = sets.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = sets.select(F.col("key").alias("k1"), "x").join(sets.select(F.col("key").alias("k2"), "x"), "x").where("k1 < k2").groupBy("k1", "k2").agg(F.count(F.lit(1)).cast("double").alias("i"))
    sized = both.join(sizes.select(F.col("key").alias("k1"), F.col("n").alias("n1")), "k1").join(sizes.select(F.col("key").alias("k2"), F.col("n").alias("n2")), "k2")
    true = joint.derived(F.col("n1") - F.col("i"), F.col("n2") - F.col("i"), F.col("i")).alias("q")
    rows = sized.select("k1", "k2", true, (F.col("n1") / (F.col("n1") + F.col("n2"))).alias("u")).withColumn("j", F.col("q.jaccard")).withColumn("b", F.explode(F.array(*map(F.lit, _BASES))))
    b, j, u = F.col("b"), F.col("j"), F.col("u")
    found = {
        "jaccard": (j, 9), "lower_p": (scalar.collision_lower(b, j), 7), "upper_p": (scalar.collision_upper(b, j), 7), "lower_j": (scalar.jaccard_lower(b, scalar.collision_lower(b, j)), 6), "upper_j": (scalar.jaccard_upper(b, scalar.collision_upper(b, j)), 6),
        "leads": (scalar.p_b(b, u - (1 - u) * j), 7), "minhash_rmse": (scalar.minhash_relative_rmse(j, _M), 7), "jaccard_rse": (scalar.fisher_rse(b, _M, u, j), 6), "difference_rse": (scalar.difference_rse(b, _M, u, j), 6),
        "intersection_rse": (scalar.intersection_rse(b, _M, u, j), 6), "against_minhash": (scalar.rmse_against_minhash(b, u, j), 6),
        "upper_bound_mse": (F.when(b == _BASES[0], scalar.upper_bound_mse(_BASES[0], _M, j)).otherwise(scalar.upper_bound_mse(_BASES[1], _M, j)), 7),
    }
    return rows.select("k1", "k2", "b", *(F.round(c, digits).alias(name) for name, (c, digits) in found.items()))


_RSD = math.sqrt(((GHLL2.b + 1) / (GHLL2.b - 1) * math.log(GHLL2.b) - 1) / GHLL2.m)


@query(
    "supplier_errors",
    f"""SELECT key, n, round(estimate / n - 1, 6) AS error, round((estimate / n - 1) / {_RSD!r}::DOUBLE, 5) AS deviations, round({_RSD * math.sqrt(GHLL2.m)!r}::DOUBLE * sqrt(log2(ln(n + 1.0::DOUBLE) / ln({GHLL2.b!r}::DOUBLE))), 6) AS efficiency,
round(pow(2.0::DOUBLE, pow(2.0::DOUBLE, -(n % 21))), 9) AS effective_base FROM ({simple_sql(registers_sql(SUPPLIER_PARTS, GHLL2), GHLL2)}) JOIN (SELECT l_suppkey AS key, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) USING (key)""",
)
def supplier_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's estimate against its exact number of parts, in standard deviations; space efficiency up to that number."""
    elements = supplier_parts(spark, sf)
    exact = elements.groupBy("key").agg(F.countDistinct("x").alias("n"))
    found = cardinality.simple(GHLL2, sketches.build(GHLL2, elements, "x", ["key"]), ["key"]).join(exact, "key")
    error = scalar.relative_error(F.col("estimate"), F.col("n"))
    efficiency = scalar.expected_rsd(GHLL2.b, 1) * F.sqrt(F.log2(F.ln(F.col("n") + 1.0) / F.ln(F.lit(GHLL2.b))))
    return found.select("key", "n", F.round(error, 6).alias("error"), F.round(error / scalar.expected_rsd(GHLL2.b, GHLL2.m), 5).alias("deviations"), F.round(efficiency, 6).alias("efficiency"), F.round(scalar.effective_base(F.col("n") % 21), 9).alias("effective_base"))


@query(
    "register_laws",
    f"""SELECT key, k, c, round({SET1.m} * (exp(-{SET1.a!r}::DOUBLE * n * pow({SET1.b!r}::DOUBLE, -k)) - exp(-{SET1.a!r}::DOUBLE * n * pow({SET1.b!r}::DOUBLE, 1 - k))), 8) AS expected
FROM (SELECT key, k, count(*) AS c FROM ({registers_sql(SEGMENT_ORDERS, SET1)}) GROUP BY key, k) JOIN (SELECT key, count(DISTINCT x) AS n FROM ({SEGMENT_ORDERS}) GROUP BY key) USING (key)""",
)
def register_laws(spark: SparkSession, sf: str) -> DataFrame:
    """How many registers of a segment's sketch have each value, and how many the law of that many elements expects."""
    elements = segment_orders(spark, sf)
    exact = elements.groupBy("key").agg(F.countDistinct("x").alias("n"))
    counts = sketches.histogram(sketches.build(SET1, elements, "x", ["key"]), ["key"]).join(exact, "key")
    law = lambda k: scalar.setsketch_cdf(SET1.b, F.col("n") * SET1.a, k)
    return counts.select("key", "k", "c", F.round(SET1.m * (law(F.col("k")) - law(F.col("k") - 1)), 8).alias("expected"))


@query(
    "series_by_discount",
    """SELECT l_discount AS x, count(*) AS n, round(any_value(CASE WHEN l_discount = 0 THEN 1 ELSE l_discount / (exp(l_discount) - 1) END), 9) AS a, round(any_value(CASE WHEN l_discount = 0 THEN 1 ELSE (exp(l_discount) - 1) / l_discount END), 9) AS b,
round(any_value(CASE WHEN l_discount = 0 THEN 1 ELSE ln(1 + l_discount) / l_discount END), 9) AS c FROM lineitem GROUP BY l_discount""",
)
def series_by_discount(spark: SparkSession, sf: str) -> DataFrame:
    """The series kernels at the discounts that occur, 0 among them."""
    x = F.col("l_discount")
    found = {"a": scalar.x_over_expm1(x), "b": scalar.expm1_over_x(x), "c": scalar.log1p_over_x(x)}
    return table(spark, sf, "lineitem").groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.first(c), 9).alias(k) for k, c in found.items()))


@query(
    "grid_of_supplier_sizes",
    f"""WITH s AS (SELECT l_suppkey AS key, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), g AS (SELECT unnest([{', '.join(map(str, GRID))}]) AS c)
SELECT c AS cardinality, count(*) AS keys, max(n) AS largest FROM s JOIN g ON c <= n GROUP BY c""",
)
def grid_of_supplier_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many suppliers reach each size of the grid, and the largest of them."""
    sizes = supplier_parts(spark, sf).groupBy("key").agg(F.countDistinct("x").alias("n"))
    cells = F.explode(F.filter(F.array(*(F.lit(c).cast("long") for c in GRID)), lambda c: c <= F.col("n")))
    return sizes.select("n", cells.alias("cardinality")).groupBy("cardinality").agg(F.count(F.lit(1)).alias("keys"), F.max("n").alias("largest"))
