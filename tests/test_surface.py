"""Bit streams over words, points in SQL text, results by configuration, batches of a stream taken again."""

import collections
import itertools

import pytest
from pyspark.sql import functions as F

from setforge.config import GeneralizedHyperLogLog, HyperLogLog, HyperMinHash, MinHash, SetSketch1, SetSketch2
from setforge.functions import bitstream, surface
from setforge.operators import cardinality, joint, sketches
from setforge.sources import results, stored
from setforge.streaming import sketch_stream


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- bit streams ----------------------------------------------------------------


def words(spark, scheme, count):
    cells = [bitstream.word(scheme, F.col("id"), w).alias(f"w{w}") for w in range(count)]
    return {r["id"]: "".join(f"{r[f'w{w}']:060b}" for w in range(count)) for r in spark.range(20).select("id", *cells).collect()}


@pytest.mark.parametrize("scheme", ["md5", "xxhash64"])
def test_reads_run_over_words(spark, scheme):
    digits = words(spark, scheme, 5)
    places = [(at, n) for at in (0, 1, 30, 59, 60, 61, 119, 150) for n in (1, 2, 59, 60, 61, 63, 64)]
    cells = [bitstream.read(scheme, F.col("id"), at, n).alias(f"r{i}") for i, (at, n) in enumerate(places)]
    for r in spark.range(20).select("id", *cells).collect():
        for i, (at, n) in enumerate(places):
            assert r[f"r{i}"] % (1 << 64) == int(digits[r["id"]][at : at + n], 2)
    for n in (0, 65):
        with pytest.raises(ValueError):
            bitstream.read(scheme, F.col("id"), 0, n)


def halves(digits, n):
    at = (n - 1).bit_length()
    c, v = int(digits[:at], 2), 1 << at
    while True:
        if v >= n:
            if c < n:
                return c
            c, v = c - n, v - n
        c, v, at = 2 * c + int(digits[at]), 2 * v, at + 1


def product(digits, n):
    for i in itertools.count():
        m = int(digits[32 * i : 32 * i + 32], 2) * n
        if m % (1 << 32) >= (1 << 32) % n:
            return m >> 32


@pytest.mark.parametrize("n", [2, 3, 5, 6, 7, 12, 1000, 3 << 29, 1 << 31])
def test_whole_numbers_without_bias(spark, n):
    digits = words(spark, "md5", 8)
    found = spark.range(20).select("id", bitstream.uniform_by_halves("md5", F.col("id"), 0, n).alias("h"), bitstream.uniform_by_product("md5", F.col("id"), 0, n).alias("p")).collect()
    assert {r["id"]: (r["h"], r["p"]) for r in found} == {i: (halves(d, n), product(d, n)) for i, d in digits.items()}


def test_whole_numbers_are_uniform(spark):
    for draw in (bitstream.uniform_by_halves, bitstream.uniform_by_product):
        counts = collections.Counter(r[0] for r in spark.range(6000).select(draw("xxhash64", F.col("id"), 17, 6)).collect())
        assert sorted(counts) == list(range(6)) and sum((c - 1000) ** 2 / 1000 for c in counts.values()) < 20.5  # 5 degrees of freedom, 0.1 %
        assert spark.range(3).select(draw("md5", F.col("id"), 0, 1).alias("v")).distinct().collect()[0]["v"] == 0
        for n in (0, (1 << 31) + 1):
            with pytest.raises(ValueError):
                draw("md5", F.col("id"), 0, n)


# ---- SQL text ---------------------------------------------------------------------


@pytest.mark.parametrize("scheme", ["md5", "xxhash64"])
@pytest.mark.parametrize("kind", [lambda s: HyperLogLog(16, 2.0, 56, scheme=s), lambda s: GeneralizedHyperLogLog(20, 1.2, 254, scheme=s), lambda s: SetSketch1(12, scheme=s), lambda s: MinHash(12, scheme=s), lambda s: HyperMinHash(4, 5, 3, scheme=s)])
def test_points_in_sql(spark, kind, scheme):
    cfg = kind(scheme)
    surface.register_points(spark, "test_points", cfg)
    df = spark.range(300).select((F.col("id") % 3).alias("key"), F.col("id").alias("x"))
    best = "min" if isinstance(cfg, MinHash) else "max"
    found = spark.sql(f"SELECT key, reg, {best}(k) AS k FROM {{df}}, LATERAL test_points(x) WHERE k > 0 GROUP BY key, reg", df=df)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    want = sketches.build(cfg, df, "x", ["key"], kernel=False).select("key", "reg", F.col("k").cast("bigint"))
    assert rows_of(found) == rows_of(want)


def test_points_that_sql_has_not(spark):
    for cfg in (SetSketch2(8), HyperLogLog(16, 2.0, 56, scheme="marked")):
        with pytest.raises(ValueError):
            surface.register_points(spark, "none", cfg)


# ---- results by configuration --------------------------------------------------------


def test_one_configuration_is_read(spark):
    folder = stored.new_folder(spark, "configurations")
    cfgs = [MinHash(m) for m in (8, 16, 32)]
    for cfg in cfgs:
        df = spark.range(4).select("id", (F.col("id") / 3 * cfg.m).alias("value"))
        for _ in range(2):  # writing a configuration again replaces it
            results.write_partitioned(df, folder, cfg.info())
    found = results.read_partitioned(spark, folder, "id bigint, value double", ["name", "m", "scheme"])
    assert found.count() == 12
    one = found.where("m = '16'")
    assert sorted((r["id"], r["value"], r["m"]) for r in one.collect()) == [(i, i / 3 * 16, "16") for i in range(4)]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(m" in plan
    read = {f.split("/m=")[1].split("/")[0] for f in one.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert read == {"16"}
    with pytest.raises(ValueError):
        results.write_partitioned(spark.range(2).withColumnRenamed("id", "M"), folder, MinHash(8).info())


def test_joint_schema(spark):
    q = joint.derived(F.col("d1"), F.col("d2"), F.col("i")).alias("q")
    truth = spark.createDataFrame([("a", 30.0, 10.0, 60.0)], "k string, d1 double, d2 double, i double").select("k", q)
    found = spark.createDataFrame([("a", "new", 32.0, 8.0, 60.0), ("a", "new", 30.0, 10.0, 50.0)], "k string, estimator string, d1 double, d2 double, i double").select("k", "estimator", q)
    bounds = spark.createDataFrame([("a", 0.5, 0.7), ("a", 0.6, 0.7)], "k string, lower double, upper double")
    row = results.joint_schema(found, truth, ["k"], ["new"], bounds).first()
    assert row.__fields__ == ["k", *results.joint_columns(["new"])] and len(row) == 1 + 12 + 24 + 4
    assert (row["trueDifference1"], row["true1"], row["trueJaccard"]) == (30, 90, 0.6)
    assert row["newMeanDifference1"] == 31 and row["newMSEDifference1"] == 2 and row["newMeanIntersection"] == 55 and row["newMSEIntersection"] == 50
    assert row["collLowerBoundMeanJaccard"] == pytest.approx(0.55) and row["collUpperBoundMSEJaccard"] == pytest.approx(0.01)


# ---- streams ------------------------------------------------------------------------


@pytest.mark.parametrize("cfg", [GeneralizedHyperLogLog(32), SetSketch2(16), MinHash(16)], ids=lambda c: c.name)
def test_a_batch_taken_again_changes_nothing(spark, cfg):
    folder = stored.new_folder(spark, "batches")
    estimate = cardinality.own(cfg)
    parts = [spark.range(n, n + 400).select((F.col("id") % 2).alias("key"), F.col("id").alias("x")) for n in (0, 200, 700)]

    def take(number):
        sketch_stream.take_batch(cfg, parts[number], number, "x", ["key"], estimate, folder)

    def found():
        spark.catalog.refreshByPath(f"{folder}/estimates")
        return rows_of(spark.read.parquet(f"{folder}/estimates"))

    for number in (0, 1, 2):
        take(number)
    before = found()
    take(2)
    assert found() == before
    whole = estimate(cfg, sketches.build(cfg, parts[0].union(parts[1]).union(parts[2]), "x", ["key"]), ["key"]).collect()
    last = {r["key"]: r["estimate"] for r in spark.read.parquet(f"{folder}/estimates").where("batch = 2").collect()}
    assert last == pytest.approx({r["key"]: r["estimate"] for r in whole})
    assert [f for f in ("batch=0", "batch=1", "batch=2") if spark._jvm.java.io.File(f"{folder.removeprefix('file://')}/state/{f}").exists()] == ["batch=1", "batch=2"]
