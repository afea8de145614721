"""Registers, merging, bulk insertion and estimates against truth and theory."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from setforge.config import GeneralizedHyperLogLog, HyperLogLog, HyperMinHash, MinHash, SetSketch1, SetSketch2
from setforge.operators import cardinality, joint, kernels, sketches
from setforge.operators.points import register_value

FAMILIES = [HyperLogLog(256, 2.0, 52), GeneralizedHyperLogLog(256), SetSketch1(64), SetSketch2(64), MinHash(64), HyperMinHash(8)]


def same_rows(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.lit("a").alias("key"), F.col("id").alias("x"))


@pytest.mark.parametrize("bad", [{"m": 0}, {"b": 1.0}, {"q": -1}, {"a": 0}, {"scheme": "other"}])
def test_parameters_are_validated(bad):
    with pytest.raises(ValueError):
        SetSketch1(**bad)


def test_hll_needs_a_power_of_two():
    with pytest.raises(ValueError):
        HyperLogLog(100)


@pytest.mark.parametrize("cfg", FAMILIES, ids=lambda c: c.name)
def test_merge_is_union_and_repeats_change_nothing(spark, cfg):
    one, two = rows(spark, 60), rows(spark, 60, 30)
    merged = sketches.merge_two(cfg, sketches.build(cfg, one, "x", ["key"]), cfg, sketches.build(cfg, two, "x", ["key"]), ["key"])
    whole = sketches.build(cfg, one.unionByName(two).unionByName(one), "x", ["key"])
    assert same_rows(merged, whole)


def test_merge_of_different_configurations_raises(spark):
    a = sketches.build(FAMILIES[1], rows(spark, 3), "x", ["key"])
    with pytest.raises(ValueError):
        sketches.merge_two(FAMILIES[1], a, GeneralizedHyperLogLog(64), a, ["key"])


@pytest.mark.parametrize("cfg", FAMILIES, ids=lambda c: c.name)
def test_nulls_and_empty_sets(spark, cfg):
    empty = rows(spark, 3).withColumn("x", F.lit(None).cast("bigint"))
    assert sketches.build(cfg, empty, "x", ["key"]).count() == 0


@pytest.mark.parametrize("cfg", FAMILIES, ids=lambda c: c.name)
def test_estimates_are_near(spark, cfg):
    n = 2000
    found = cardinality.estimates(cfg, sketches.build(cfg, rows(spark, n), "x", ["key"]), ["key"]).collect()
    assert found
    for r in found:
        assert abs(r["estimate"] / n - 1) < 5 * 1.3 / math.sqrt(cfg.m), r


def test_ml_solves_its_equation():
    cfg = GeneralizedHyperLogLog(256)
    rng = np.random.default_rng(5)
    k = np.minimum(cfg.q + 1, np.floor(1 - np.log2(rng.random(1000)))).astype(int)
    regs = np.zeros(256, int)
    np.maximum.at(regs, rng.integers(0, 256, 1000), k)
    counts = np.bincount(regs, minlength=cfg.q + 2).astype(float)
    assert abs(cardinality.ml_from_counts(cfg, counts) / 1000 - 1) < 0.2
    counts = np.zeros(cfg.q + 2)
    counts[0] = 256
    assert cardinality.ml_from_counts(cfg, counts) == 0
    assert cardinality.ml_from_counts(cfg, counts[::-1].copy()) == math.inf


def test_empty_setsketch_keeps_its_small_estimate(spark):
    cfg = SetSketch1(64)
    touched = spark.createDataFrame([("a", 0, 0)], "key string, reg int, k int")
    raw = cardinality.simple(cfg, touched, ["key"]).first()["estimate"]
    assert raw == pytest.approx((1 - 1 / cfg.b) / (cfg.a * cfg.log_b))
    assert cardinality.simple(cfg, touched, ["key"], empty_as_zero=True).first()["estimate"] == 0


def test_sigma_and_tau_limits():
    assert cardinality.sigma(2, 0) == 0 and cardinality.sigma(2, 1) == math.inf
    assert cardinality.tau(2, 0.0) == 0 and cardinality.tau(2, 1.0) == 0
    assert cardinality.sigma(2, 0.5) == pytest.approx(0.5 + sum(2 ** (k - 1) * 0.5 ** (2**k) for k in range(1, 12)))


def test_register_values(spark):
    xs = [1.5, 1.0, 0.75, 0.5, 0.3, 1e-30]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(register_value(F.col("x"), 2.0, 62)).collect()]
    assert got == [0, 1, 1, 2, 2, 63]


@pytest.mark.parametrize("cfg", [SetSketch1(16), SetSketch2(16)], ids=lambda c: c.name)
def test_bulk_equals_stream(spark, cfg):
    data = rows(spark, 150).unionByName(rows(spark, 40).withColumn("key", F.lit("b")))
    bulk, attempts = sketches.bulk(cfg, data, "x", ["key"])
    assert same_rows(bulk.select("key", "reg", "k"), sketches.build(cfg, data, "x", ["key"], kernel=False))
    assert attempts.count() == 2


def test_marked_kernel_merges_and_estimates(spark):
    cfg = SetSketch1(256, 2.0, 62, 20.0, scheme="marked")
    one, two = (sketches.build(cfg, rows(spark, 1000, s), "x", ["key"]) for s in (0, 500))
    merged = sketches.merge(cfg, one.unionByName(two), ["key"])
    assert same_rows(merged, sketches.build(cfg, rows(spark, 1500), "x", ["key"]))
    estimate = cardinality.simple(cfg, merged, ["key"]).first()["estimate"]
    assert abs(estimate / 1500 - 1) < 0.35


def test_minhash_kernel(spark):
    cfg = MinHash(1024)
    estimate = cardinality.minhash(cfg, sketches.build(cfg, rows(spark, 3000), "x", ["key"]), ["key"]).first()["estimate"]
    assert abs(estimate / 3000 - 1) < 0.2


MARKED = [
    HyperLogLog(64, 2.0, 58, scheme="marked"), GeneralizedHyperLogLog(100, 1.2, 200, scheme="marked"), SetSketch1(48, 2.0, 62, 20.0, scheme="marked"),
    SetSketch2(48, 2.0, 62, 20.0, scheme="marked"), SetSketch2(64, 1.001, 65534, 20.0, scheme="marked"), HyperMinHash(6, 6, 10, scheme="marked"),
]


@pytest.mark.parametrize("cfg", MARKED, ids=lambda c: f"{c.name}-{getattr(c, 'b', '')}")
def test_pruned_registers_equal_unpruned_ones(cfg):
    ids = kernels.stream(np.arange(20_000, dtype=np.uint64), 9, 9)
    pruned, every, doubled = kernels.block(cfg), kernels.block(cfg, math.inf), kernels.block(cfg)
    for part in np.array_split(ids, 50):
        pruned.add(part)
        every.add(part)
    doubled.add(np.concatenate([ids[::-1], ids]))
    assert pruned.lowest > 0 and every.lowest == 0
    assert (pruned.k == every.k).all() and (doubled.k == every.k).all()
    if isinstance(cfg, (SetSketch1, SetSketch2)):
        limit = -math.log1p(-(0.95 ** (1 / cfg.m))) / (cfg.a * 20_000)
        small = kernels.block(cfg, limit)
        small.add(ids)
        enough = math.floor(1 - math.log(limit) / cfg.log_b)
        assert ((small.k == every.k) | (every.k <= enough)).all()


def test_strata_are_dealt_by_permutations():
    for m in (1, 2, 5, 16, 100):
        registers = kernels.block(SetSketch2(m, scheme="marked"))
        ids = kernels.stream(np.arange(200, dtype=np.uint64), 0, 0)
        dealt = np.stack([registers.dealt(ids, j) for j in range(m)])
        assert (np.sort(dealt, axis=0) == np.arange(m)[:, None]).all()
        assert m < 5 or len({tuple(c) for c in dealt.T}) > 50


@pytest.mark.parametrize("cfg", MARKED, ids=lambda c: f"{c.name}-{getattr(c, 'b', '')}")
def test_marked_estimates_over_many_sets(cfg):
    # the mean of 200 estimates lies within five of its standard errors
    own, n = [], 400
    for example in range(200):
        registers = kernels.block(cfg)
        registers.add(kernels.stream(np.arange(n, dtype=np.uint64), example, 5))
        if isinstance(cfg, HyperMinHash):
            k, hll = registers.k >> cfg.sub_bits, cfg.as_hll()
        else:
            k, hll = registers.k, cfg
        own.append(cardinality.ml_from_counts(hll, np.bincount(k, minlength=hll.q + 2).astype(float)))
    assert abs(np.mean(own) / n - 1) < 5 * np.std(own) / n / math.sqrt(200) + 0.01
    assert 0.3 < np.std(own) / n * math.sqrt(cfg.m) < 1.4


@pytest.mark.parametrize("cfg", MARKED[2:4], ids=lambda c: c.name)
def test_marked_bulk_equals_marked_stream(spark, cfg):
    data = rows(spark, 150).unionByName(rows(spark, 40).withColumn("key", F.lit("b")))
    bulk, attempts = sketches.bulk(cfg, data, "x", ["key"])
    assert same_rows(bulk.select("key", "reg", "k"), sketches.build(cfg, data, "x", ["key"]))
    assert attempts.count() == 2
    whole, once = sketches.bulk(cfg, data, "x", [])
    assert same_rows(whole.select("reg", "k"), sketches.build(cfg, data, "x", [])) and once.count() == 1


def test_bulk_limit_succeeds_as_designed():
    for cfg in MARKED[2:4]:
        hits = 0
        limit = -math.log1p(-(0.95 ** (1 / cfg.m))) / (cfg.a * 200)
        for seed in range(300):
            registers = kernels.block(cfg, limit)
            registers.add(np.arange(seed * 1000, seed * 1000 + 200, dtype=np.uint64))
            hits += math.floor(1 - math.log2(limit)) <= registers.k.min()
        assert hits / 300 > 0.85


def test_prefixes_are_running_sketches(spark):
    cfg = GeneralizedHyperLogLog(64)
    got = sketches.prefixes(cfg, rows(spark, 300), "x", ["key"], "x", 100)
    last = got.where("prefix = 3").select("key", "reg", "k")
    assert same_rows(last, sketches.build(cfg, rows(spark, 300), "x", ["key"]))


# ---- joint quantities -----------------------------------------------------


def two_sets(spark, n1, n2, both):
    one = spark.range(n1).select(F.lit("a").alias("key"), F.col("id").alias("x"))
    return one.unionByName(spark.range(n1 - both, n1 - both + n2).select(F.lit("b").alias("key"), F.col("id").alias("x")))


WANTED = "k1 string, k2 string"


@pytest.mark.parametrize("cfg", [GeneralizedHyperLogLog(1024), SetSketch1(256, 1.2, 254), MinHash(256), HyperMinHash(10)], ids=lambda c: c.name)
def test_joint_estimates_are_near(spark, cfg):
    data = two_sets(spark, 3000, 2000, 1000)
    regs = sketches.build(cfg, data, "x", ["key"], kernel=False).persist()
    known = spark.createDataFrame([("a", 3000.0), ("b", 2000.0)], "key string, estimate double")
    found = joint.joint(cfg, regs, "key", spark.createDataFrame([("a", "b")], WANTED), known).collect()
    labels = {r["estimator"] for r in found}
    assert {"new", "inclExcl", "newKnownCard"} <= labels
    for r in found:
        assert abs(r["q"]["jaccard"] - 0.25) < 0.15, r


def test_corrected_joint_helps_small_sets(spark):
    cfg = GeneralizedHyperLogLog(256)
    regs = sketches.build(cfg, two_sets(spark, 80, 80, 40), "x", ["key"])
    wanted = spark.createDataFrame([("a", "b")], WANTED)
    compared = joint.with_cardinalities(joint.pairs(cfg, regs, "key", wanted), cardinality.simple(cfg, regs, ["key"]), "key")
    plain = joint.joint_new(cfg, compared).first()["q"]["jaccard"]
    better = joint.joint_new(cfg, compared, joint_range_correction=True).first()["q"]["jaccard"]
    assert abs(better - 1 / 3) < abs(plain - 1 / 3)


def test_likelihood_search_finds_the_grid_maximum(spark):
    rng = np.random.default_rng(3)
    cases = [(float(rng.integers(50, 500)), float(rng.integers(50, 500)), *map(int, rng.multinomial(256, [0.3, 0.3, 0.4]))) for _ in range(12)]
    df = spark.createDataFrame(cases, "n1 double, n2 double, p long, q long, e long")
    got = [r[0] for r in df.select(joint.jaccard_ml(2.0, *(F.col(c) for c in ("n1", "n2", "p", "q", "e")))).collect()]
    assert joint.jaccards_ml(2.0, *zip(*cases)) == pytest.approx(got, abs=1e-6)
    for (n1, n2, p, q, e), j in zip(cases, got):
        u, v = n1 / (n1 + n2), n2 / (n1 + n2)
        grid = np.linspace(0, min(u / v, v / u) * (1 - 1e-9), 20001)
        pb = lambda x: -np.log1p(-x / 2) / math.log(2)
        a, b = pb(np.maximum(0, u - v * grid)), pb(np.maximum(0, v - u * grid))
        value = p * np.log(np.maximum(a, 1e-300)) + q * np.log(np.maximum(b, 1e-300)) + e * np.log(np.maximum(1 - a - b, 1e-300))
        assert abs(grid[np.argmax(value)] - j) < 1e-3


def test_derived_quantities_guard_against_empty_sets(spark):
    q = spark.range(1).select(joint.from_jaccard(F.lit(0.0), F.lit(0.0), F.lit(0.5)).alias("q")).first()["q"]
    assert all(v == 0 for v in q.asDict().values())
    q = spark.range(1).select(joint.derived(F.lit(3.0), F.lit(1.0), F.lit(4.0)).alias("q")).first()["q"]
    assert (q["union"], q["jaccard"], q["inclusion1"], q["alpha"]) == (8, 0.5, 4 / 7, 3 / 8)
    assert q["cosine"] == pytest.approx(4 / math.sqrt(35))


def test_mu_sums_to_the_logarithm():
    assert joint.mu(1.001, np.array([3.0]), np.array([9.0]))[0] == pytest.approx(math.log(3) / math.log(1.001), rel=1e-6)
