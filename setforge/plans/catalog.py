"""The queries of the sketch engine, each with its SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.config import GeneralizedHyperLogLog, HyperLogLog, HyperMinHash, MinHash, SetSketch1, SetSketch2
from setforge.functions import scalar
from setforge.operators import cardinality, joint, points, sketches, stats
from setforge.plans import experiments
from setforge.sources import grids

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

HLL = HyperLogLog(256, 2.0, 52, scheme="md5")
GHLL2 = GeneralizedHyperLogLog(256, 2.0, 62, scheme="md5")
GHLL1001 = GeneralizedHyperLogLog(256, 1.001, 65534, scheme="md5")
SET1 = SetSketch1(64, 2.0, 62, 20.0, scheme="md5")
SET2 = SetSketch2(64, 2.0, 62, 20.0, scheme="md5")
MIN = MinHash(64, scheme="md5")
HMH = HyperMinHash(8, 6, 10, scheme="md5")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- elements -------------------------------------------------------------


def supplier_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("x"))


def segment_orders(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("key"))
    orders = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("x"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("key", "x")


def priority_customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("x"))


SUPPLIER_PARTS = "SELECT l_suppkey AS key, l_partkey AS x FROM lineitem"
SEGMENT_ORDERS = "SELECT c_mktsegment AS key, o_orderkey AS x FROM orders JOIN customer ON o_custkey = c_custkey"
PRIORITY_CUSTOMERS = "SELECT o_orderpriority AS key, o_custkey AS x FROM orders"


# ---- SQL of the families --------------------------------------------------


def _hex(text: str, start: int, size: int) -> str:
    return f"('0x' || substr(md5({text}), {start}, {size}))::BIGINT"


def _value(x: str, b: float, q: int) -> str:
    return f"greatest(0, least({q + 1}, floor(1 - ln({x}) / ln({b!r}::DOUBLE))))::INT"


def _one_sql(source: str, cfg) -> str:
    """Registers of families with one update an element."""
    x = "x::VARCHAR"
    if isinstance(cfg, HyperLogLog):
        reg, k = f"(h >> {60 - cfg.p})::INT", f"least(bit_count(xor(h, h + 1)), {cfg.q + 1})::INT"
    elif isinstance(cfg, GeneralizedHyperLogLog):
        reg, k = f"({_hex(x, 1, 8)} % {cfg.m})::INT", _value(f"(({_hex(x, 9, 13)} + 0.5::DOUBLE) / {float(16**13)!r}::DOUBLE)", cfg.b, cfg.q)
    else:
        reg = f"({_hex(x, 16, 5)} % {cfg.m})::INT"
        k = f"(least(bit_count(xor(h, h + 1)), {1 << cfg.bucket_size})::INT * {1 << cfg.sub_bits} + ({_hex(x, 22, 6)} % {1 << cfg.sub_bits}))::INT"
    return f"SELECT key, reg, max(k) AS k FROM (SELECT key, {reg} AS reg, {k} AS k FROM (SELECT key, x, {_hex(x, 1, 15)} AS h FROM ({source}))) WHERE k > 0 GROUP BY key, reg"


def _many_sql(source: str, cfg) -> str:
    """Registers of families in which an element updates every register."""
    x = "x::VARCHAR || '|' || reg::VARCHAR"
    rows = f"(SELECT key, x, reg::INT AS reg FROM (SELECT DISTINCT key, x FROM ({source})), range({cfg.m}) r(reg))"
    if isinstance(cfg, MinHash):
        return f"SELECT key, reg, min({_hex(x, 1, 15)}) AS k FROM {rows} GROUP BY key, reg"
    u = f"(({_hex(x, 9, 13)} + 0.5::DOUBLE) / {float(16**13)!r}::DOUBLE)"
    if isinstance(cfg, SetSketch1):
        point, rows = f"(-ln({u}) / {cfg.a!r}::DOUBLE)", f"(SELECT key, reg, {u} AS u FROM {rows})"
        point = f"(-ln(u) / {cfg.a!r}::DOUBLE)"
    else:
        rows = f"(SELECT key, reg, {u} AS u, row_number() OVER (PARTITION BY key, x ORDER BY {_hex(x, 23, 8)}, reg) - 1 AS stratum FROM {rows})"
        point = f"(-ln(1 - (stratum + u) / {float(cfg.m)!r}::DOUBLE) / {cfg.a!r}::DOUBLE)"
    return f"SELECT key, reg, max(k) AS k FROM (SELECT key, reg, {_value(point, cfg.b, cfg.q)} AS k FROM {rows}) WHERE k > 0 GROUP BY key, reg"


def registers_sql(source: str, cfg) -> str:
    return (_many_sql if isinstance(cfg, (MinHash, SetSketch1, SetSketch2)) else _one_sql)(source, cfg)


def simple_sql(registers: str, cfg, key: str = "key") -> str:
    """(key, estimate)."""
    b, m, q = cfg.b, cfg.m, cfg.q
    factor = m * (1 - 1 / b) / (cfg.rate * cfg.log_b)
    counts = f"SELECT {key}, {m} - sum((k > 0)::INT) AS c0, sum((k > {q})::INT) AS ctop, coalesce(sum(CASE WHEN k > 0 AND k <= {q} THEN pow({b!r}::DOUBLE, -k) END), 0) AS inner_sum FROM ({registers}) GROUP BY {key}"
    if cfg.range_correction:
        # the series that stand for untouched and for saturated registers, summed term by term
        x, y = f"(c0 / {m}::DOUBLE)", f"(1 - ctop / {m}::DOUBLE)"
        terms = int(80 / math.log(b)) + 8
        low = f"CASE WHEN c0 = {m} THEN 'infinity'::DOUBLE WHEN c0 = 0 THEN 0 ELSE {x} + {b - 1!r} * list_sum(list_transform(range(1, {terms}), lambda i: pow({b!r}::DOUBLE, i - 1) * exp(greatest(-700.0::DOUBLE, pow({b!r}::DOUBLE, i) * ln({x}))))) END"
        high = f"CASE WHEN ctop = {m} OR ctop = 0 THEN 0 ELSE 1 - {y} + {b - 1!r} * list_sum(list_transform(range(0, {terms}), lambda i: pow({b!r}::DOUBLE, -i - 1) * (pow({y}, pow({b!r}::DOUBLE, -i)) - 1))) END"
        return f"SELECT {key}, {factor!r}::DOUBLE / (inner_sum + {m} * ({low}) + {m * b**-q!r}::DOUBLE * ({high})) AS estimate FROM ({counts})"
    return f"SELECT {key}, {factor!r}::DOUBLE / (inner_sum + c0 + ctop * {b ** -(q + 1)!r}::DOUBLE) AS estimate FROM ({counts})"


def minhash_sql(registers: str, key: str = "key") -> str:
    return f"SELECT {key}, {MIN.m}::DOUBLE / sum(-ln(1 - (k + 0.5::DOUBLE) / {float(MIN.span)!r}::DOUBLE)) AS estimate FROM ({registers}) GROUP BY {key}"


def _rounded(df: DataFrame, digits: int = 4, keep: tuple[str, ...] = ("key",)) -> DataFrame:
    return df.select(*keep, *(F.round(c, digits).alias(c) for c in df.columns if c not in keep))


# ---- registers ------------------------------------------------------------

for _name, _cfg in (("hll_registers", HLL), ("ghll_registers_b2", GHLL2), ("ghll_registers_b1001", GHLL1001)):
    query(_name, registers_sql(SUPPLIER_PARTS, _cfg))(lambda s, d, c=_cfg: sketches.build(c, supplier_parts(s, d), "x", ["key"]))
for _name, _cfg in (("setsketch1_registers", SET1), ("setsketch2_registers", SET2), ("minhash_registers", MIN), ("hyperminhash_registers", HMH)):
    query(_name, registers_sql(SEGMENT_ORDERS, _cfg))(lambda s, d, c=_cfg: sketches.build(c, segment_orders(s, d), "x", ["key"]))

for _name, _cfg in (("hll", HLL), ("ghll", GHLL2), ("setsketch1", SET1), ("setsketch2", SET2)):
    query(f"{_name}_cardinality_simple", f"SELECT key, round(estimate, 4) AS estimate FROM ({simple_sql(registers_sql(SEGMENT_ORDERS, _cfg), _cfg)})")(
        lambda s, d, c=_cfg: _rounded(cardinality.simple(c, sketches.build(c, segment_orders(s, d), "x", ["key"]), ["key"]))
    )

query("minhash_cardinality", f"SELECT key, round(estimate, 4) AS estimate FROM ({minhash_sql(registers_sql(SEGMENT_ORDERS, MIN))})")(
    lambda s, d: _rounded(cardinality.minhash(MIN, sketches.build(MIN, segment_orders(s, d), "x", ["key"]), ["key"]))
)
_HMH_HLL = f"SELECT key, reg, k >> {HMH.sub_bits} AS k FROM ({registers_sql(SEGMENT_ORDERS, HMH)})"
query("hyperminhash_cardinality_new", f"SELECT key, round(estimate, 4) AS estimate FROM ({simple_sql(_HMH_HLL, HMH.as_hll())})")(
    lambda s, d: _rounded(cardinality.hyperminhash_new(HMH, sketches.build(HMH, segment_orders(s, d), "x", ["key"]), ["key"]))
)
_ALPHA = 0.7213 / (1 + 1.079 / HMH.m)
query(
    "hyperminhash_cardinality_original",
    f"""SELECT key, round(CASE WHEN raw <= {2.5 * HMH.m} AND c0 > 0 THEN {HMH.m} * ln({HMH.m}::DOUBLE / c0) ELSE raw END, 4) AS estimate
FROM (SELECT key, {HMH.m} - count(*) AS c0, {_ALPHA * HMH.m**2!r}::DOUBLE / (sum(pow(2.0::DOUBLE, -(k >> {HMH.sub_bits}))) + {HMH.m} - count(*)) AS raw
FROM ({registers_sql(SEGMENT_ORDERS, HMH)}) GROUP BY key)""",
)(lambda s, d: _rounded(cardinality.hyperminhash_original(HMH, sketches.build(HMH, segment_orders(s, d), "x", ["key"]), ["key"], corrected=False)))

query("hyperminhash_to_ghll", f"SELECT key, reg, least(k - {(1 << HMH.sub_bits) - 1}, {HMH.as_ghll().q + 1})::INT AS k FROM ({registers_sql(SEGMENT_ORDERS, HMH)})")(
    lambda s, d: joint.hyperminhash_as_ghll(HMH, sketches.build(HMH, segment_orders(s, d), "x", ["key"]))
)
query("hyperminhash_to_hll", _HMH_HLL)(lambda s, d: joint.hyperminhash_as_hll(HMH, sketches.build(HMH, segment_orders(s, d), "x", ["key"])))


# ---- merging and describing ----------------------------------------------


@query("merge_union_registers", registers_sql(f"SELECT 'all' AS key, x FROM ({SEGMENT_ORDERS})", GHLL2))
def merge_union(spark: SparkSession, sf: str) -> DataFrame:
    parts = sketches.build(GHLL2, segment_orders(spark, sf), "x", ["key"])
    return sketches.merge(GHLL2, parts.withColumn("key", F.lit("all")), ["key"])


@query("merge_minhash_registers", registers_sql(f"SELECT 'all' AS key, x FROM ({SEGMENT_ORDERS})", MIN))
def merge_minhash(spark: SparkSession, sf: str) -> DataFrame:
    parts = sketches.build(MIN, segment_orders(spark, sf), "x", ["key"])
    return sketches.merge(MIN, parts.withColumn("key", F.lit("all")), ["key"])


_CHUNKS = "SELECT floor(log2(o_orderkey + 1))::INT AS key, o_orderkey AS x FROM orders"


@query(
    "compose_binary",
    f"WITH p AS ({registers_sql(_CHUNKS, GHLL2)}), w AS (SELECT DISTINCT n FROM (SELECT max(o_orderkey) AS n FROM orders GROUP BY o_custkey)) SELECT n, reg, max(k) AS k FROM w JOIN p ON (n >> p.key) & 1 = 1 GROUP BY n, reg",
)
def compose_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of as many elements as each customer's last order key says, from sketches of powers of two."""
    orders = table(spark, sf, "orders")
    powers = sketches.build(GHLL2, orders.select(F.floor(F.log2(F.col("o_orderkey") + 1)).cast("int").alias("e"), F.col("o_orderkey").alias("x")), "x", ["e"])
    return sketches.compose(GHLL2, powers, orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("n")).select("n").distinct())


query("register_histogram", f"SELECT key, k, count(*) AS c FROM ({registers_sql(SEGMENT_ORDERS, GHLL2)}) GROUP BY key, k")(lambda s, d: sketches.histogram(sketches.build(GHLL2, segment_orders(s, d), "x", ["key"]), ["key"]))
query("register_minimum", f"SELECT key, CASE WHEN count(*) < {GHLL2.m} THEN 0 ELSE min(k) END AS minimum FROM ({registers_sql(SUPPLIER_PARTS, GHLL2)}) GROUP BY key")(
    lambda s, d: sketches.minimum(GHLL2, sketches.build(GHLL2, supplier_parts(s, d), "x", ["key"]), ["key"])
)
query("state_checksum", f"SELECT key, sum(k)::BIGINT AS checksum FROM ({registers_sql(SUPPLIER_PARTS, GHLL2)}) GROUP BY key")(
    lambda s, d: sketches.checksum(sketches.build(GHLL2, supplier_parts(s, d), "x", ["key"]), ["key"]).withColumn("checksum", F.col("checksum").cast("bigint"))
)
query("dense_registers", f"SELECT key, reg, coalesce(k, 0)::INT AS k FROM (SELECT key, reg FROM (SELECT DISTINCT key FROM ({SEGMENT_ORDERS})), range({GHLL2.m}) t(reg)) LEFT JOIN ({registers_sql(SEGMENT_ORDERS, GHLL2)}) r USING (key, reg)")(
    lambda s, d: sketches.dense(GHLL2, sketches.build(GHLL2, segment_orders(s, d), "x", ["key"]), ["key"]).select("key", F.posexplode("registers").alias("reg", "k")).withColumn("reg", F.col("reg").cast("bigint"))
)


@query(
    "prefix_registers",
    f"""WITH n AS (SELECT event_type AS key, event_id AS x, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 500 + 1 AS prefix FROM events),
e AS (SELECT DISTINCT key, prefix FROM n), c AS (SELECT e.key || '#' || e.prefix AS key, n.x FROM e JOIN n ON n.key = e.key AND n.prefix <= e.prefix)
SELECT split_part(key, '#', 1) AS key, split_part(key, '#', 2)::BIGINT AS prefix, reg, k FROM ({registers_sql("SELECT * FROM c", GHLL2)})""",
)
def prefix_registers(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("x"))
    return sketches.prefixes(GHLL2, events, "x", ["key"], "x", 500)


# ---- joint quantities -----------------------------------------------------


def key_pairs(df: DataFrame) -> DataFrame:
    """All pairs of the few distinct keys."""
    keys = df.select("key").distinct()
    return keys.select(F.col("key").alias("k1")).join(keys.select(F.col("key").alias("k2")), F.col("k1") < F.col("k2"))


def _compared(cfg, spark: SparkSession, sf: str, estimate) -> tuple[DataFrame, DataFrame, DataFrame]:
    elements = priority_customers(spark, sf)
    regs, wanted = sketches.build(cfg, elements, "x", ["key"]), key_pairs(elements)
    return regs, wanted, joint.with_cardinalities(joint.pairs(cfg, regs, "key", wanted), estimate(cfg, regs, ["key"]), "key")


RATIOS = ("jaccard", "cosine", "inclusion1", "inclusion2", "alpha", "beta")


def _spread(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select("k1", "k2", *(F.round(f"q.{c}", digits + 2 if c in RATIOS else digits).alias(c) for c in joint.QUANTITIES))


def compared_sql(cfg, cardinalities: str, source: str = PRIORITY_CUSTOMERS) -> str:
    """WITH parts: r registers, k keys, c pairs with how registers compare and both cardinalities."""
    regs = registers_sql(source, cfg)
    empty = cfg.span if isinstance(cfg, MinHash) else 0
    return f"""r AS ({regs}), est AS ({cardinalities}), ks AS (SELECT DISTINCT key FROM r),
full_regs AS (SELECT ks.key, g.reg, coalesce(r.k, {empty}) AS k FROM ks CROSS JOIN range({cfg.m}) g(reg) LEFT JOIN r ON r.key = ks.key AND r.reg = g.reg),
c AS (SELECT a.key AS k1, b.key AS k2, sum((a.k > b.k)::INT) AS d_plus, sum((a.k < b.k)::INT) AS d_minus, sum((a.k = b.k)::INT) AS d_equal,
 sum((a.k = b.k AND a.k = {getattr(cfg, "q", -2) + 1})::INT) AS both_top, sum((a.k = b.k AND a.k <> {empty})::INT) AS matches, sum((a.k <> {empty} OR b.k <> {empty})::INT) AS filled
 FROM full_regs a JOIN full_regs b ON a.reg = b.reg AND a.key < b.key GROUP BY a.key, b.key),
p AS (SELECT c.*, e1.estimate AS n1, e2.estimate AS n2 FROM c JOIN est e1 ON e1.key = k1 JOIN est e2 ON e2.key = k2)"""


def quantities_sql(jaccard: str, source: str = "p", digits: int = 4) -> str:
    """The twelve quantities from n1, n2 and a Jaccard expression, ratios with two digits more."""
    return f"""j0 AS (SELECT k1, k2, n1, n2, greatest(0, least({jaccard}, n1 / n2, n2 / n1)) AS j FROM {source}),
j1 AS (SELECT k1, k2, greatest(0, n1 - n2 * j) / (1 + j) AS d1, greatest(0, n2 - n1 * j) / (1 + j) AS d2, (n1 + n2) * j / (1 + j) AS i FROM j0)
SELECT k1, k2, round(d1, {digits}) AS difference1, round(d2, {digits}) AS difference2, round(i, {digits}) AS intersection, round(d1 + i, {digits}) AS cardinality1, round(d2 + i, {digits}) AS cardinality2,
round(d1 + d2 + i, {digits}) AS "union", round(i / (d1 + d2 + i), {digits + 2}) AS jaccard, round(i / sqrt((d1 + i) * (d2 + i)), {digits + 2}) AS cosine, round(i / (d1 + i), {digits + 2}) AS inclusion1, round(i / (d2 + i), {digits + 2}) AS inclusion2,
round(d1 / (d1 + d2 + i), {digits + 2}) AS alpha, round(d2 / (d1 + d2 + i), {digits + 2}) AS beta FROM j1"""


_R = "SELECT * FROM r"
_GHLL_PAIRS = compared_sql(GHLL2, simple_sql(_R, GHLL2))
_MIN_PAIRS = compared_sql(MIN, minhash_sql(_R))

query("joint_register_counts", f"WITH {_GHLL_PAIRS} SELECT k1, k2, d_plus::BIGINT AS d_plus, d_minus::BIGINT AS d_minus, d_equal::BIGINT AS d_equal FROM c")(
    lambda s, d: joint.pairs(GHLL2, sketches.build(GHLL2, e := priority_customers(s, d), "x", ["key"]), "key", key_pairs(e)).select("k1", "k2", "d_plus", "d_minus", "d_equal")
)
query("joint_difference_histogram", f"WITH {_GHLL_PAIRS} SELECT a.key AS k1, b.key AS k2, (a.k - b.k)::BIGINT AS difference, count(*) AS c FROM full_regs a JOIN full_regs b ON a.reg = b.reg AND a.key < b.key WHERE a.k > 0 OR b.k > 0 GROUP BY ALL")(
    lambda s, d: joint.difference_histogram(sketches.build(GHLL2, e := priority_customers(s, d), "x", ["key"]), "key", key_pairs(e))
)


@query(
    "joint_incl_excl",
    f"WITH {_GHLL_PAIRS}, merged AS (SELECT a.key || '~' || b.key AS key, a.reg, greatest(a.k, b.k) AS k FROM full_regs a JOIN full_regs b ON a.reg = b.reg AND a.key < b.key), "
    f"u AS ({simple_sql('SELECT * FROM merged', GHLL2)}), pu AS (SELECT p.*, u.estimate AS nu FROM p JOIN u ON u.key = k1 || '~' || k2), {quantities_sql('(n1 + n2 - nu) / nu', 'pu')}",
)
def joint_incl_excl(spark: SparkSession, sf: str) -> DataFrame:
    regs, wanted, compared = _compared(GHLL2, spark, sf, cardinality.simple)
    return _spread(joint.joint_incl_excl(compared.join(joint.union_estimate(GHLL2, regs, "key", wanted, cardinality.simple), joint.PAIR)))


def larger_share(x: str, b: float) -> str:
    """Share of registers that are larger on one side, from that side's own share of elements."""
    return f"(-ln(1 - ({x}) * {(b - 1) / b!r}::DOUBLE) / ln({b!r}::DOUBLE))"


_INV = lambda c: f"((1 - pow(2.0::DOUBLE, -{c} / {GHLL2.m}::DOUBLE)) * 2)"
query("joint_simple_deprecated", f"WITH {_GHLL_PAIRS}, {quantities_sql(f'greatest(0, 1 - {_INV('d_plus')} - {_INV('d_minus')})')}")(lambda s, d: _spread(joint.joint_simple_deprecated(GHLL2, _compared(GHLL2, s, d, cardinality.simple)[2])))
query(
    "joint_bounds",
    f"WITH {_GHLL_PAIRS} SELECT k1, k2, round(greatest(0, 2 * (pow(2.0::DOUBLE, (d_equal / {GHLL2.m}::DOUBLE + 1) / 2) - 1) - 1), 6) AS lower, round(pow(2.0::DOUBLE, d_equal / {GHLL2.m}::DOUBLE) - 1, 6) AS upper FROM c",
)(lambda s, d: _rounded(joint.bounds(GHLL2.b, GHLL2.m, _compared(GHLL2, s, d, cardinality.simple)[2]), 6, ("k1", "k2")))

query("joint_minhash_original", f"WITH {_MIN_PAIRS}, {quantities_sql(f'd_equal / {MIN.m}::DOUBLE')}")(lambda s, d: _spread(joint.minhash_original(MIN, _compared(MIN, s, d, cardinality.minhash)[2])))
query("joint_minhash_simple_deprecated", f"WITH {_MIN_PAIRS}, {quantities_sql(f'greatest(0, 1 - d_minus / {MIN.m}::DOUBLE - d_plus / {MIN.m}::DOUBLE)')}")(
    lambda s, d: _spread(joint.minhash_simple_deprecated(MIN, _compared(MIN, s, d, cardinality.minhash)[2]))
)
query(
    "joint_minhash_new",
    f"WITH {_MIN_PAIRS}, ab AS (SELECT *, n1 * n1 * (d_equal + d_plus) AS a, n2 * n2 * (d_equal + d_minus) AS b FROM p), "
    + quantities_sql(f"least(1, greatest(0, (a + b - sqrt(pow(a - b, 2) + 4.0 * d_plus * d_minus * n1 * n1 * n2 * n2)) / (2.0 * {MIN.m} * n1 * n2)))", "ab"),
)(lambda s, d: _spread(joint.minhash_new(MIN, _compared(MIN, s, d, cardinality.minhash)[2])))

_HMH_PAIRS = compared_sql(HMH, simple_sql(f"SELECT key, reg, k >> {HMH.sub_bits} AS k FROM r", HMH.as_hll()))
_SHARE = lambda n: f"(pow(1 - (CASE WHEN i = {1 << HMH.bucket_size} THEN 0 ELSE pow(2.0::DOUBLE, -i) / {HMH.m} END), {n}) - pow(1 - pow(2.0::DOUBLE, 1 - i) / {HMH.m}, {n}))"
query(
    "joint_hyperminhash_original",
    f"WITH {_HMH_PAIRS}, cp AS (SELECT k1, k2, sum({_SHARE('n1')} * {_SHARE('n2')}) * {HMH.m} / {float(1 << HMH.sub_bits)!r}::DOUBLE AS expected FROM p, range(1, {(1 << HMH.bucket_size) + 1}) t(i) GROUP BY k1, k2), "
    f"pc AS (SELECT p.*, expected FROM p JOIN cp USING (k1, k2)), {quantities_sql('greatest(0, matches - expected) / filled', 'pc')}",
)(lambda s, d: _spread(joint.hyperminhash_original_joint(HMH, _compared(HMH, s, d, cardinality.hyperminhash_new)[2])))


# ---- bulk insertion, streams ---------------------------------------------


@query("bulk_registers", registers_sql(SUPPLIER_PARTS, SET1))
def bulk_registers(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.bulk(SET1, supplier_parts(spark, sf), "x", ["key"])[0]


@query("bulk_registers_setsketch2", registers_sql(SEGMENT_ORDERS, SET2))
def bulk_registers_setsketch2(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.bulk(SET2, segment_orders(spark, sf), "x", ["key"])[0]


@query("bulk_equals_stream", "SELECT l_suppkey AS key, 0::BIGINT AS differing FROM lineitem GROUP BY l_suppkey")
def bulk_equals_stream(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.bulk_test(SET2, supplier_parts(spark, sf), "x", "key").select("key", "differing")


@query("stream_registers", registers_sql("SELECT event_type AS key, user_id AS x FROM events", GHLL2))
def stream_registers(spark: SparkSession, sf: str) -> DataFrame:
    """A file stream read to its end, its running sketch kept in memory."""
    from setforge.sources.stored import new_folder
    from setforge.streaming.sketch_stream import to_memory

    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf}/event[s].parquet")
    name = f"running_{uuid.uuid4().hex}"
    to_memory(GHLL2, stream.select(F.col("event_type").alias("key"), F.col("user_id").alias("x")), "x", ["key"], name, new_folder(spark, name)).awaitTermination()
    return spark.table(name)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# ---- statistics and theory ------------------------------------------------


@query(
    "error_stats",
    "SELECT event_type, round(avg(value), 6) AS mean, round(avg(pow(value - 50, 2)), 6) AS mse, round(stddev_pop(value), 6) AS std, round(kurtosis_pop(value) + 3, 6) AS kurtosis FROM events GROUP BY event_type",
)
def error_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "events").groupBy("event_type").agg(*stats.error_stats(F.col("value"), F.lit(50)))
    return _rounded(found, 6, ("event_type",))


_BASES = (1.001, 1.2, 2.0, 4.0)
_JS = (0.0, 0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9)


def _grid(spark: SparkSession, **columns: tuple) -> DataFrame:
    df = spark.range(1)
    for name, values in columns.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df.drop("id")


def _grid_sql(**columns: tuple) -> str:
    return "SELECT * FROM " + ", ".join(f"(SELECT unnest([{', '.join(f'{v!r}::{"INT" if isinstance(v, int) else "DOUBLE"}' for v in values)}]) AS {name})" for name, values in columns.items())


query("expected_rsd", f"SELECT b, m, round(sqrt(((b + 1) / (b - 1) * ln(b) - 1) / m), 9) AS rsd, round(sqrt((b + 1) / (b - 1) * ln(b) - 1) * sqrt(log2(ln(1.8446744073709552e19) / ln(b))), 9) AS efficiency FROM ({_grid_sql(b=_BASES, m=(256, 4096))})")(
    lambda s, d: _grid(s, b=_BASES, m=(256, 4096)).select("b", "m", F.round(scalar.expected_rsd(F.col("b"), F.col("m")), 9).alias("rsd"), F.round(scalar.space_efficiency(F.col("b"), 2.0**64), 9).alias("efficiency"))
)
query(
    "collision_bounds",
    f"""SELECT b, j, round(ln(1 + j * (b - 1)) / ln(b), 9) AS lower_p, round(ln(1 + j * (b - 1) + pow(1 - j, 2) * pow(b - 1, 2) / (4 * b)) / ln(b), 9) AS upper_p,
round(greatest(0, 2 * (pow(b, (j + 1) / 2) - 1) / (b - 1) - 1), 9) AS lower_j, round((pow(b, j) - 1) / (b - 1), 9) AS upper_j, round(j * (1 - j) / 256, 9) AS minhash_mse,
round(-ln(1 - j * (b - 1) / b) / ln(b), 9) AS p FROM ({_grid_sql(b=_BASES, j=_JS)})""",
)(
    lambda s, d: _grid(s, b=_BASES, j=_JS).select(
        "b", "j",
        *(F.round(c, 9).alias(n) for n, c in {
            "lower_p": scalar.collision_lower(F.col("b"), F.col("j")), "upper_p": scalar.collision_upper(F.col("b"), F.col("j")),
            "lower_j": scalar.jaccard_lower(F.col("b"), F.col("j")), "upper_j": scalar.jaccard_upper(F.col("b"), F.col("j")),
            "minhash_mse": scalar.minhash_mse(F.col("j"), 256), "p": scalar.p_b(F.col("b"), F.col("j")),
        }.items()),
    )
)
_FISHER = """WITH g AS ({grid}), p AS (SELECT *, 1 - u AS v, u - (1 - u) * j AS x, (1 - u) - u * j AS y FROM g),
q AS (SELECT *, -ln(1 - x * (b - 1) / b) / ln(b) AS px, -ln(1 - y * (b - 1) / b) / ln(b) AS py, (b - 1) / (b * ln(b)) AS f FROM p),
i AS (SELECT *, f * f * (pow(v * pow(b, px), 2) / px + pow(u * pow(b, py), 2) / py + pow(v * pow(b, px) + u * pow(b, py), 2) / (1 - px - py)) AS info FROM q)
SELECT b, u, j, round(1 / sqrt(4096 * info) / j, 6) AS jaccard_rse, round(1 / sqrt(4096 * info) / x / (1 + j), 6) AS difference_rse, round(1 / sqrt(4096 * info) / j / (1 + j), 6) AS intersection_rse,
round(1 / sqrt(info * j * (1 - j)), 6) AS against_minhash FROM i"""
_FG = {"b": _BASES, "u": (0.4, 0.5, 0.6), "j": (0.01, 0.1, 0.3, 0.5)}
query("fisher_rse", _FISHER.format(grid=_grid_sql(**_FG)))(
    lambda s, d: _grid(s, **_FG).select(
        "b", "u", "j",
        F.round(scalar.fisher_rse(F.col("b"), 4096, F.col("u"), F.col("j")), 6).alias("jaccard_rse"), F.round(scalar.difference_rse(F.col("b"), 4096, F.col("u"), F.col("j")), 6).alias("difference_rse"),
        F.round(scalar.intersection_rse(F.col("b"), 4096, F.col("u"), F.col("j")), 6).alias("intersection_rse"), F.round(scalar.rmse_against_minhash(F.col("b"), F.col("u"), F.col("j")), 6).alias("against_minhash"),
    )
)
query(
    "register_pmf",
    """SELECT k::INT AS k, round(CASE WHEN k > 0 THEN pow(2.0::DOUBLE, -k) ELSE 0 END, 12) AS ghll, round(exp(-20 * pow(2.0::DOUBLE, -k)) - exp(-20 * pow(2.0::DOUBLE, 1 - k)), 12) AS setsketch,
round(CASE WHEN k > 0 THEN pow(2.0::DOUBLE, -((k + 3) // 4)) / 4 ELSE 0 END, 12) AS hyperminhash FROM range(0, 41) t(k)""",
)(
    lambda s, d: s.range(41).select(
        F.col("id").cast("int").alias("k"),
        F.round(F.when(F.col("id") > 0, scalar.ghll_cdf(2.0, F.col("id")) - scalar.ghll_cdf(2.0, F.col("id") - 1)).otherwise(0.0), 12).alias("ghll"),
        F.round(scalar.setsketch_cdf(2.0, 20.0, F.col("id")) - scalar.setsketch_cdf(2.0, 20.0, F.col("id") - 1), 12).alias("setsketch"),
        F.round(scalar.hyperminhash_cdf(2, F.col("id")) - scalar.hyperminhash_cdf(2, F.col("id") - 1), 12).alias("hyperminhash"),
    )
)
query("series_kernels", f"SELECT x, round(CASE WHEN x = 0 THEN 1 ELSE x / (exp(x) - 1) END, 9) AS a, round(CASE WHEN x = 0 THEN 1 ELSE (exp(x) - 1) / x END, 9) AS b, round(CASE WHEN x = 0 THEN 1 ELSE ln(1 + x) / x END, 9) AS c FROM ({_grid_sql(x=(0.0, 0.25, 1.0, 3.5))})")(
    lambda s, d: _grid(s, x=(0.0, 0.25, 1.0, 3.5)).select("x", F.round(scalar.x_over_expm1(F.col("x")), 9).alias("a"), F.round(scalar.expm1_over_x(F.col("x")), 9).alias("b"), F.round(scalar.log1p_over_x(F.col("x")), 9).alias("c"))
)
query("register_mapping", f"SELECT l_orderkey, l_linenumber, {_value('l_discount + 0.001::DOUBLE', 1.2, 254)} AS k, (l_discount <= 0 OR (3 <= 254 AND l_discount <= pow(1.2::DOUBLE, -3))) AS relevant FROM lineitem")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", points.register_value(F.col("l_discount") + 0.001, 1.2, 254).alias("k"), points.is_relevant(F.col("l_discount"), F.lit(3), 1.2, 254).alias("relevant"))
)


# ---- sources --------------------------------------------------------------

query("one_two_five_grid", "SELECT (d * pow(10, e))::BIGINT AS cardinality FROM (SELECT unnest([1, 2, 5]) AS d), range(8) t(e) WHERE d * pow(10, e) <= 10000000")(lambda s, d: grids.grid_frame(s, grids.one_two_five()))
query(
    "cardinality_grid",
    "WITH RECURSIVE g(c) AS (SELECT 10000000::BIGINT UNION ALL SELECT least(c - 1, ceil(c / (1 + 0.01::DOUBLE))::BIGINT) FROM g WHERE c > 0) SELECT c AS cardinality FROM g",
)(lambda s, d: grids.grid_frame(s, grids.cardinality_grid(10_000_000, 0.01)))
query(
    "set_triples",
    """WITH RECURSIVE g AS (SELECT n, n // x AS i, 1::DOUBLE AS r FROM (SELECT unnest([1000000, 1000])::BIGINT AS n), (SELECT unnest([2, 10, 100, 1000])::BIGINT AS x)
 UNION ALL SELECT n, i, r * 1.2::DOUBLE FROM g WHERE floor((n - i) / (1 + 1 / r)) < 1000 * (n - i - floor((n - i) / (1 + 1 / r))))
SELECT DISTINCT floor((n - i) / (1 + 1 / r))::BIGINT AS diff1, (n - i - floor((n - i) / (1 + 1 / r)))::BIGINT AS diff2, i AS intersection FROM g""",
)(lambda s, d: grids.triples_frame(s))


# ---- randomness -----------------------------------------------------------

query(
    "rng_chi2",
    f"SELECT count(*) AS cells, sum(c)::BIGINT AS n, round(sum(c * c) * 16.0 / sum(c) - sum(c), 6) AS chi2 FROM (SELECT {_hex("o_orderkey::VARCHAR || '|0'", 1, 1)} AS v, count(*) AS c FROM orders GROUP BY v)",
)(lambda s, d: _chi2(s, d))
query(
    "bit_consistency",
    f"SELECT b::INT AS bits, count(*) AS n, 0::BIGINT AS differing, sum((h >> (60 - b)) % 1009)::BIGINT AS checksum FROM (SELECT {_hex("o_orderkey::VARCHAR || '|0'", 1, 15)} AS h FROM orders), range(1, 61) t(b) GROUP BY b",
)(lambda s, d: experiments.bit_consistency(table(s, d, "orders"), "o_orderkey"))


def _chi2(spark: SparkSession, sf: str) -> DataFrame:
    from setforge.functions.random import uniform_int

    drawn = table(spark, sf, "orders").select(uniform_int("md5", F.col("o_orderkey"), 0, 16).alias("v"))
    found = stats.chi_square(drawn, "v", 16, [])
    return found.select(F.lit(16).cast("bigint").alias("cells"), "n", F.round("chi2", 6).alias("chi2"))


query(
    "rng_ks",
    f"""SELECT n, round(max(greatest(i / n::DOUBLE - u, u - (i - 1) / n::DOUBLE)), 9) AS d FROM (SELECT u, row_number() OVER (ORDER BY u) AS i, count(*) OVER () AS n
FROM (SELECT ({_hex("o_orderkey::VARCHAR || '|0'", 1, 13)} + 0.5::DOUBLE) / {float(16**13)!r}::DOUBLE AS u FROM orders)) GROUP BY n""",
)(lambda s, d: _ks(s, d))


def _ks(spark: SparkSession, sf: str) -> DataFrame:
    from setforge.functions.random import uniform

    drawn = table(spark, sf, "orders").select(F.lit(1).alias("all"), uniform("md5", F.col("o_orderkey"), 0).alias("u"))
    return stats.ks_uniform(drawn, "u", ["all"]).select("n", F.round("d", 9).alias("d"))


