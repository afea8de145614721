"""Theory, sources, streams, experiments, randomness and the driver's contract."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from setforge.config import GeneralizedHyperLogLog, HyperMinHash, SetSketch1
from setforge.functions import random, scalar, theory
from setforge.operators import joint, sketches, stats
from setforge.plans import experiments
from setforge.sources import grids, results
from setforge.streaming import sketch_stream


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_gamma():
    assert theory.gamma(complex(5, 0)).real == pytest.approx(24)
    assert abs(theory.gamma(complex(1, 1))) == pytest.approx(math.sqrt(math.pi / math.sinh(math.pi)))


def test_fourier_amplitudes_shrink_with_the_base():
    assert theory.max_amplitude_xi(2, 1) < theory.max_amplitude_xi(4, 1) < 0.1
    assert theory.max_amplitude_zeta(2, 41) < theory.max_amplitude_zeta(4, 41)
    direct = sum(2.0 ** (0.3 + k) * math.exp(-(2.0 ** (0.3 + k))) for k in range(-60, 20)) * math.log(2)
    assert (direct - 1) ** 2 == pytest.approx(float(theory.xi_squared_error(np.array(0.3), 2, 1)), rel=1e-3)


def test_upper_bound_mse_agrees_with_the_sum(spark):
    for j in (0.1, 0.5):
        assert value(spark, scalar.upper_bound_mse(2.0, 256, F.lit(j))) == pytest.approx(theory.upper_bound_mse(j, 256, 2.0), rel=1e-6)


def test_superminhash_is_better_than_minhash(spark):
    j, m = F.lit(0.5), 64
    assert value(spark, scalar.superminhash_relative_rmse(j, m, F.lit(32.0))) < value(spark, scalar.minhash_relative_rmse(j, m))


def test_register_laws_sum_to_one(spark):
    last = value(spark, scalar.hyperminhash_cdf(3, F.lit(8 * 40)))
    assert last == pytest.approx(1)
    first = value(spark, scalar.hyperminhash_cdf(3, F.lit(1)))
    assert first == pytest.approx(0.5 / 8)


def test_grids():
    assert len(grids.cardinality_grid(10_000_000, 0.01)) == 1316
    assert grids.one_two_five(1000) == [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000]
    found = grids.triples()
    assert len(found) == 156 + 138 and all(sum(t) in (1000, 1_000_000) for t in found)


def test_result_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1), (2, 1 / 3)], "cardinality bigint, seconds double")
    path = str(tmp_path / uuid.uuid4().hex)
    results.write(df, path, {"name": "x", "dummy": "", "m": "4"}, ["cardinality"])
    cells = results.read(spark, path + "/*.txt")
    wide = results.wide(cells, ["cardinality", "seconds"]).orderBy("cardinality").collect()
    assert [(r["cardinality"], r["seconds"]) for r in wide] == [(1.0, 0.1), (2.0, 1 / 3)]
    assert cells.first()["info"] == {"name": "x", "dummy": "", "m": "4"}
    assert results.parse_metadata(results.metadata_line({"a": "1", "dummy": ""})) == {"a": "1", "dummy": ""}


def test_numbers_round_trip(spark, tmp_path):
    path = str(tmp_path / "n")
    results.write_numbers(spark.range(5), "id", path)
    assert sorted(r["value"] for r in results.read_numbers(spark, path).collect()) == [0, 1, 2, 3, 4]


def test_stream_equals_batch_with_replayed_rows(spark, tmp_path):
    cfg = SetSketch1(16)
    rows = spark.range(100).select((F.col("id") % 2).alias("key"), F.col("id").alias("x"))
    for part in ("1", "2"):
        rows.write.parquet(str(tmp_path / "in" / part))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"t{uuid.uuid4().hex}"
    sketch_stream.to_memory(cfg, stream, "x", ["key"], name, str(tmp_path / "c")).awaitTermination()
    got = spark.table(name).where("k > 0")
    want = sketches.build(cfg, rows, "x", ["key"])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_error_stats(spark):
    x = np.random.default_rng(1).normal(5, 2, 2000)
    r = spark.createDataFrame([(float(v),) for v in x], "x double").agg(*stats.error_stats(F.col("x"), F.lit(4.0))).first()
    assert r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std())
    assert r["mse"] == pytest.approx(((x - 4) ** 2).mean()) and r["kurtosis"] == pytest.approx((((x - x.mean()) / x.std()) ** 4).mean())


def test_generators_pass_their_tests(spark):
    rows = spark.range(4000)
    for r in experiments.rng_quality(rows, "id").collect():
        name, statistic, n = r["generator"], r["statistic"], r["n"]
        kind, cells = random.GENERATORS[name][1:3]
        if kind == "integer":
            assert statistic < cells - 1 + 5 * math.sqrt(2 * (cells - 1)) + 5, name
        elif kind == "real":
            assert statistic < 2 / math.sqrt(n), name
        else:
            assert abs(statistic) < 4.5, name


def test_bits_read_singly(spark):
    assert all(r["differing"] == 0 for r in experiments.bit_consistency(spark.range(50), "id").collect())


def test_permutations(spark):
    rows = random.permutation(spark.range(20), "xxhash64", "id", "item", 5).groupBy("id").agg(F.sort_array(F.collect_list("place")).alias("p"))
    assert all(r["p"] == [0, 1, 2, 3, 4] for r in rows.collect())


def test_accuracy_follows_theory(spark):
    cfg = GeneralizedHyperLogLog(64)
    found = experiments.error_series(experiments.cardinality_accuracy(spark, cfg, 60, [1, 100, 1000]), cfg)
    for r in found.where("cardinality = 1000").collect():
        assert abs(r["rmse"] / r["expected"] - 1) < 0.35, r
    assert found.count() == 6


def test_joint_accuracy_has_all_quantities(spark):
    triples = [(200, 100, 100)]
    found = experiments.joint_accuracy(spark, SetSketch1(64), triples, 8)
    labels = {r["estimator"] for r in found.select("estimator").distinct().collect()}
    assert labels == {"new", "inclExcl", "newKnownCard", "inclExclKnownCard"}
    assert found.count() == 4 * 12
    assert experiments.joint_series(found, triples, SetSketch1(64), spark).count() == 8


def test_throughput_series(spark):
    found = experiments.throughput_series(experiments.throughput(spark, GeneralizedHyperLogLog(64), [10, 100])).collect()
    assert [r["cardinality"] for r in found] == [10, 100] and all(r["seconds_an_element"] > 0 for r in found)


def test_hyperminhash_views(spark):
    cfg = HyperMinHash(8, 6, 4)
    ghll = cfg.as_ghll()
    assert ghll.b == cfg.effective_base and cfg.as_hll().b == 2


def test_contract(spark):
    names = contract.queries()
    assert set(contract.oracle_sql()) <= set(names)
    assert contract.entry(spark).count() > 0


def test_own_shares_are_those_of_largest_likelihood():
    cfg = GeneralizedHyperLogLog(m=256, b=2.0, q=62)
    rng = np.random.default_rng(3)
    grid = (np.arange(400) + 0.5) / 400

    def at_least(share, lead):
        s = share * cfg.b ** (1.0 - lead)
        return np.log(cfg.b * (s + 1 - share) / (s + cfg.b * (1 - share))) / np.log(cfg.b)

    def log_likelihood(histogram):
        return sum((c * np.log(at_least(grid, lead) - at_least(grid, lead + 1)) for lead, c in histogram.items()), np.zeros(len(grid)))

    cases = [({1: 5, 2: 3}, {1: 9, 3: 1}, 200.0), ({1: 40, 2: 9, 5: 1}, {}, 90.0), ({}, {}, 256.0), ({}, {2: 1}, 255.0)]
    cases += [({k + 1: int(c) for k, c in enumerate(rng.integers(1, 30, 4))}, {k + 1: int(c) for k, c in enumerate(rng.integers(1, 30, 3))}, float(rng.integers(1, 99))) for _ in range(4)]
    one, two = joint.own_shares(cfg, [c[0] for c in cases], [c[1] for c in cases], np.array([c[2] for c in cases]))
    for (ahead, behind, equal), x, y in zip(cases, one, two):
        first, second = np.where(bool(ahead), at_least(grid, 1), 0.0)[:, None], np.where(bool(behind), at_least(grid, 1), 0.0)[None, :]
        rest = 1 - first - second
        value = log_likelihood(ahead)[:, None] + log_likelihood(behind)[None, :] + np.where(rest > 0, equal * np.log(np.maximum(rest, 1e-300)), -np.inf)
        i, j = np.unravel_index(np.argmax(value), value.shape)
        assert abs(x - (grid[i] if ahead else 0)) < 0.004 and abs(y - (grid[j] if behind else 0)) < 0.004


def test_results_are_selected_by_configuration(spark, tmp_path):
    for m, mode in (("100", "fast"), ("10", "fast"), ("100", "slow0")):
        results.write(spark.createDataFrame([(0, float(m)), (1, 2.0)], "at0 int, `1v` double"), f"{tmp_path}/{m}-{mode}", {"0m": m, "mode": mode, "100": ""}, ["at0"])
    cells = results.read(spark, f"{tmp_path}/*/part-*")
    picked = results.of_config(cells, **{"0m": "100", "mode": "slow0"})
    assert {r["file"].split("/")[-2] for r in picked.collect()} == {"100-slow0"}
    assert picked.select("info").first()["info"] == {"0m": "100", "mode": "slow0", "100": ""}
    assert sorted((r["row"], r["at0"], r["1v"]) for r in results.wide(picked, ["at0", "1v"]).collect()) == [(0, 0.0, 100.0), (1, 1.0, 2.0)]
    assert not results.of_config(cells, mode="none").collect()
