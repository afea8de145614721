"""What only larger tables bring about: saturated sketches, many keys, many pairs."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from setforge.config import GeneralizedHyperLogLog, HyperLogLog, HyperMinHash, MinHash, SetSketch1, SetSketch2
from setforge.functions import random
from setforge.operators import cardinality, digests, joint, kernels, packed, points, similarity, sketches, stats
from setforge.plans import catalog, experiments, states, tables

COARSE = GeneralizedHyperLogLog(64, 2.0, 6)


@pytest.fixture
def saturated(spark):
    """Pairs of which one sketch, or none, has an infinite estimate, as all its registers are saturated."""
    rows = [
        ("a", "b", math.inf, 900.0, 40, 0, 24, 0, 24, math.inf),
        ("b", "c", 900.0, math.inf, 0, 40, 24, 0, 24, math.inf),
        ("d", "e", 60.0, 80.0, 12, 20, 32, 9, 0, 110.0),
    ]
    return spark.createDataFrame(rows, "k1 string, k2 string, n1 double, n2 double, d_plus bigint, d_minus bigint, d_equal bigint, both_zero bigint, both_top bigint, union double")


def jaccards(df):
    return {r["k1"]: r["jaccard"] for r in df.select("k1", "q.jaccard").collect()}


def test_both_options_with_infinite_estimates(saturated):
    found = jaccards(joint.joint_new(COARSE, saturated, True, True))
    assert found["a"] == found["b"] == 0
    assert found["d"] == pytest.approx(joint.jaccards_corrected(COARSE, [60], [80], [12], [20], [32], [9])[0])


def test_correction_with_infinite_estimates(saturated):
    found = jaccards(joint.joint_new(COARSE, saturated, joint_range_correction=True))
    assert found["a"] == found["b"] == 0 and 0 < found["d"] < 0.75


def test_fallback_with_infinite_estimates(saturated):
    found = {r["k1"]: r["q"] for r in joint.joint_new(COARSE, saturated, incl_excl_fallback=True).collect()}
    assert found["a"]["jaccard"] == found["b"]["jaccard"] == 0
    assert (found["a"]["cardinality1"], found["a"]["cardinality2"], found["a"]["intersection"]) == (math.inf, 900, 0)
    assert found["d"]["jaccard"] == pytest.approx(30 / 110)


# ---- many updates an element ---------------------------------------------------

MANY = [SetSketch1(16, scheme="md5"), SetSketch2(16, scheme="md5"), MinHash(16, scheme="md5")]


def test_digests_on_arrays():
    texts = [b"", b"7", b"31415926", b"x" * 50, b"y" * 52, b"z" * 53, b"q" * 90, "\u00e9~1".encode()]
    found = digests.digests(texts, 130)
    for i, text in enumerate(texts):
        for reg in (0, 9, 10, 99, 100, 129):
            assert "".join(f"{int(w[i, reg]):08x}" for w in found) == hashlib.md5(text + b"|%d" % reg).hexdigest()


@pytest.mark.parametrize("cfg", MANY, ids=lambda c: type(c).__name__)
def test_updates_of_many_keys_are_few(spark, cfg):
    """Of 300 keys with 40 elements each, tasks send about a row a key and register, however the elements lie."""
    df = spark.range(12000).repartition(8).select((F.col("id") % 300).alias("key"), F.col("id").alias("x"))
    sent = points.updates(cfg, df, "x", ["key"]).count()
    assert sent <= (300 + 2 * 8) * cfg.m
    assert sketches.build(cfg, df, "x", ["key"]).groupBy("key").count().count() == 300


@pytest.mark.parametrize("scheme", ["md5", "xxhash64"])
def test_strata_are_dealt_inside_a_row(spark, scheme):
    """The order of an element's registers needs no window, so the rows of all registers are never shuffled."""
    plan = sketches.build(SetSketch2(16, scheme=scheme), spark.range(10).withColumn("key", F.lit(1)), "id", ["key"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_bulk_by_digests_with_null_keys_and_long_texts(spark):
    """Bulk and streaming insertion agree for keys of several columns, null ones and elements of more than one block."""
    cfg = SetSketch2(16, scheme="md5")
    x = F.concat(F.when(F.col("id") % 7 == 0, F.repeat(F.lit("long"), 20)).otherwise(F.lit("")), F.col("id").cast("string"))
    df = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("a"), (F.col("id") % 2 == 0).alias("b"), x.alias("x"))
    df = df.unionByName(df)
    bulk, attempts = sketches.bulk(cfg, df, "x", ["a", "b"])
    stream = sketches.build(cfg, df, "x", ["a", "b"])
    assert sorted(map(repr, bulk.collect())) == sorted(map(repr, stream.collect()))
    assert attempts.count() == 6


# ---- few rows a key ---------------------------------------------------------------


def test_composed_sketches_are_not_shuffled(spark):
    """The registers of n elements come from one row of ``wanted``; null is no number."""
    cfg = MinHash(16)
    powers = sketches.build(cfg, spark.range(1, 64).select(F.floor(F.log2("id")).cast("int").alias("e"), F.col("id")), "id", ["e"])
    wanted = spark.createDataFrame([(5,), (40,), (0,), (None,)], "n bigint")
    found = sketches.compose(cfg, powers, wanted)
    rows = {n: sorted((r["reg"], r["k"]) for r in found.where(F.col("n") == n).collect()) for n in (0, 5, 40)}
    parts = lambda *es: sorted(map(tuple, powers.where(F.col("e").isin(*es)).groupBy("reg").agg(F.min("k")).collect()))
    assert rows == {0: [], 5: parts(0, 2), 40: parts(3, 5)}
    # the numbers are told apart, and nothing is joined or grouped by register
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


@pytest.mark.parametrize("cfg", [HyperLogLog(64, 2.0, 58, scheme="marked"), GeneralizedHyperLogLog(200, 1.2, 254, scheme="marked"), HyperMinHash(6, 6, 10, scheme="marked")], ids=["hll", "ghll", "hyperminhash"])
def test_many_keys_hold_no_blocks(spark, cfg, monkeypatch):
    """A batch with few rows a key takes points without blocks; the registers are the same."""
    df = spark.range(6000).select(F.when(F.col("id") % 1500 > 0, F.col("id") % 1500).alias("key"), F.col("id").alias("x")).coalesce(1)
    rows = lambda: sorted(map(repr, sketches.build(cfg, df, "x", ["key"]).collect()))
    loose = rows()
    sent = kernels.partial_registers(cfg, df, "x", ["key"])
    assert sent.count() == 6000  # an element a row, and none twice
    monkeypatch.setattr(kernels, "ROWS_A_KEY", 0)
    assert rows() == loose


def test_large_hyperminhash_estimates_as_the_sql_has_them(spark, tmp_path):
    """Estimates of 2^18 and more stay raw, as the query's SQL leaves them."""
    duckdb = pytest.importorskip("duckdb")
    cfg = catalog.HMH
    # registers of two sets, one beyond 2^18; the estimator alone is compared, on rows that stand for those of elements
    rows = [(key, reg, (at + reg % 3) << cfg.sub_bits | reg * 3) for key, at in (("large", 14), ("small", 3)) for reg in range(cfg.m)]
    df = spark.createDataFrame(rows, "key string, reg int, k int")
    got = {r["key"]: r["estimate"] for r in cardinality.hyperminhash_original(cfg, df, ["key"], corrected=False).collect()}
    df.write.parquet(str(tmp_path / "r"))
    sql = catalog.ORACLE_SQL["hyperminhash_cardinality_original"].replace(catalog.registers_sql(catalog.SEGMENT_ORDERS, cfg), f"SELECT * FROM '{tmp_path}/r/*.parquet'")
    want = dict(duckdb.sql(sql).fetchall())
    assert want["large"] > 1 << 18 and got == pytest.approx(want, abs=1e-4)
    whole = {r["key"]: r["estimate"] for r in cardinality.hyperminhash_original(cfg, df, ["key"]).collect()}
    assert whole["small"] == got["small"] and whole["large"] != got["large"]


def test_the_query_leaves_large_estimates_raw(spark, monkeypatch):
    """The registered query asks for that."""
    cfg = catalog.HMH
    rows = [("large", reg, 14 << cfg.sub_bits) for reg in range(cfg.m)]
    monkeypatch.setattr(catalog, "segment_orders", lambda s, d: None)
    monkeypatch.setattr(catalog.sketches, "build", lambda *a, **b: spark.createDataFrame(rows, "key string, reg int, k int"))
    found = catalog.QUERIES["hyperminhash_cardinality_original"](spark, "").collect()[0]["estimate"]
    assert found == pytest.approx(0.7213 / (1 + 1.079 / cfg.m) * cfg.m * 2**14, rel=1e-6)


# ---- many similar pairs --------------------------------------------------------------


def test_pairs_meet_once_and_whole(spark):
    """Pairs of sets that share bands come once each, whatever the cells, and with the counts of a plain comparison."""
    cfg = SetSketch1(16, 1.2, 254, 2.0)
    rows = [(key, x) for key in range(40) for x in range(60) if (x * 7 + key * x) % 11 > 2]
    regs = sketches.build(cfg, spark.createDataFrame(rows, "key int, x int"), "x", ["key"]).cache()
    keys, states = similarity.band_keys(cfg, regs, "key", 2), packed.pack(cfg, regs, ["key"])
    want = {(r["k1"], r["k2"]) for r in similarity.candidates(keys, "key").collect()}
    for block in (7, 2000):
        found = similarity.met(cfg, states, keys, "key", 2, 0.0, block).collect()
        assert len(found) == len(want) and {(r["k1"], r["k2"]) for r in found} == want
    compared = packed.pairs_packed(cfg, states, "key", spark.createDataFrame(list(want), "k1 int, k2 int"))
    plain = {(r["k1"], r["k2"]): (r["d_plus"], r["d_minus"], r["d_equal"]) for r in compared.collect()}
    assert {(r["k1"], r["k2"]): (r["d_plus"], r["d_minus"], r["d_equal"]) for r in found} == plain
    ml = {(r["k1"], r["k2"]): r["j"] for r in compared.select("k1", "k2", joint.jaccard_ml(cfg.b, *(F.col(c) for c in ("n1", "n2", "d_plus", "d_minus", "d_equal"))).alias("j")).collect()}
    assert all(r["jaccard"] == pytest.approx(ml[r["k1"], r["k2"]], abs=1e-6) for r in found)


def test_shared_elements_are_hashed_once(monkeypatch):
    """A batch in which keys share elements takes the digests of each once, and gives what each row's own would."""
    cfg, texts = states.SIMILAR, [b"%d" % (i * i % 37) for i in range(500)]
    plain, hashed = digests.values(cfg, texts), []
    monkeypatch.setattr(digests, "values", lambda c, t, limits=None, of=digests.values: hashed.extend(t) or of(c, t, limits))
    for some in (texts, texts[:3]):
        hashed.clear()
        give = digests._given(cfg, pa.array(some, pa.binary()), None)
        found = np.concatenate([give(lo, lo + 64) for lo in range(0, len(some), 64)])
        assert np.array_equal(found, plain[: len(some)]) and len(hashed) == len(set(some))
    limits = np.full(len(texts), 0.01)
    assert np.array_equal(digests._given(cfg, pa.array(texts, pa.binary()), limits)(0, 500), digests.values(cfg, texts, limits))


def test_every_link_is_found(spark, tmp_path):
    """Similar suppliers are all pairs of enough likeness: equal sets, and those that no band would bring together, whatever the blocks."""
    cfg, rng = states.SIMILAR, np.random.default_rng(5)
    core = rng.permutation(states.FAMILIES)
    held = {s: {int(x) for x in core[rng.random(states.FAMILIES) < 0.72]} for s in range(24)} | {24: {1, 2}}
    held |= {s + 100: held[s] for s in range(12)} | {s + 200: held[s] for s in range(5)}
    rows = [(s, x + states.FAMILIES * (s // 100)) for s, own in held.items() for x in own] + [(None, 3), (5, None)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))

    registers = {s: digests.values(cfg, [str(x).encode() for x in own]).max(axis=0) for s, own in held.items()}
    n = dict(zip(registers, packed._simple(cfg, np.stack(list(registers.values())))))
    pairs = [(a, b) for a in held for b in held if a < b]
    plus, minus = (np.array([f(registers[a], registers[b]) for a, b in pairs]) for f in (lambda x, y: (x > y).sum(), lambda x, y: (x < y).sum()))
    found = joint.jaccards_ml(cfg.b, [n[a] for a, _ in pairs], [n[b] for _, b in pairs], plus, minus, cfg.m - plus - minus)
    want = {p: pytest.approx(j, abs=1e-4) for p, j in zip(pairs, found) if j >= states.LEAST}
    assert 100 < len(want) < len(pairs) - 50 and (0, 100) in want and (24, 100) not in want

    got = states.similar_suppliers(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["k1"], r["k2"]): r["jaccard"] for r in got} == want
    regs = sketches.build(cfg, spark.read.parquet(f"{tmp_path}/lineitem.parquet").select("l_suppkey", (F.col("l_partkey") % states.FAMILIES).alias("x")), "x", ["l_suppkey"])
    for block in (3, 1000):
        some = similarity.every_link(cfg, regs, "l_suppkey", states.LEAST, block).collect()
        assert len(some) == len(want) and {(r["k1"], r["k2"]) for r in some} == set(want)
    assert not similarity.every_link(cfg, regs.limit(0), "l_suppkey", 0.5).collect()


def test_running_registers_end_where_streams_do(spark):
    """Prefixes that a stream does not reach have no rows; the others are what they were."""
    cfg, grid = GeneralizedHyperLogLog(16, scheme="md5"), [1, 5, 20, 100]
    streams = spark.range(30).select((F.col("id") % 2).alias("example"), F.floor(F.col("id") / 2).alias("i"), F.col("id").alias("element")).where("example = 0 OR i < 6")
    most = streams.groupBy("example").agg(F.count(F.lit(1)).alias("most"))
    rows = lambda df: sorted(map(tuple, df.select("example", "cardinality", "reg", "k").collect()))
    cut = rows(experiments.running_registers(cfg, streams, grid, most))
    assert {r[:2] for r in cut} == {(0, 1), (0, 5), (1, 1), (1, 5)}
    assert cut == rows(experiments.running_registers(cfg, streams, grid).join(most, "example").where("cardinality <= most"))


# ---- results of many rows ---------------------------------------------------------------


def test_round_trip_joins_nothing(spark):
    """Registers and sizes come from one reading of the states: no side of a join can be sent to the driver, and null keys stay."""
    cfg = GeneralizedHyperLogLog(16, scheme="md5")
    rows = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("key"), F.col("id").alias("x"))
    found = states._round_trip(cfg, rows)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = sketches.build(cfg, rows, "x", ["key"]).select("key", "reg", F.col("k").cast("bigint"), F.lit(packed.size(cfg)))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, want.collect())))


# ---- draws of many elements ---------------------------------------------------------------


def hashed(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("md5(")


def test_bits_cost_one_hash_an_element(spark):
    """However many bits are read, an element is hashed once and no row is copied for a number of bits; null elements count as rows."""
    rows = spark.createDataFrame([(7,), (None,), (31,)], "id bigint")
    checks = experiments.bit_consistency(rows, "id")
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and hashed(checks) == 1
    words = [int(hashlib.md5(b"%d|0" % i).hexdigest()[:15], 16) for i in (7, 31)]
    want = [(b, 3, 0, sum((w >> 60 - b) % 1009 for w in words)) for b in range(1, 61)]
    assert sorted(map(tuple, checks.collect())) == want
    assert [tuple(r) for r in experiments.bit_consistency(rows.where("id IS NULL"), "id", most=1).collect()] == [(1, 1, None, None)]


def test_draws_cost_one_hash_an_element(spark):
    """All generators draw from one hash a step, as they do from hashes of their own."""
    rows = spark.range(20)
    drawn = experiments.samples(rows, "id", "md5", 2)
    assert hashed(drawn) == 1
    for name in ("uniform_int_16", "uniform_int_7", "truncated_exponential_0.5", "one_bit"):
        own = rows.select(random.GENERATORS[name][0]("md5", F.col("id"), F.lit(1)).cast("double"))
        assert sorted(map(tuple, drawn.where((F.col("generator") == name) & (F.col("step") == 1)).select("value").collect())) == sorted(map(tuple, own.collect()))


@pytest.mark.parametrize("cells", [4, 1 << 16])
@pytest.mark.parametrize("sent", [0, 1 << 15])
def test_distance_from_rows_of_few_cells(spark, monkeypatch, cells, sent):
    """The distance is that of numbering all rows, of which only those of cells that may hold it are numbered."""
    monkeypatch.setattr(stats, "CELLS", cells)
    monkeypatch.setattr(stats, "SENT", sent)
    numbered, scanned = [], stats.scan.numbered
    monkeypatch.setattr(stats.scan, "numbered", lambda df, *rest: numbered.append(df.count()) or scanned(df, *rest))
    rng = np.random.default_rng(5)
    groups = {None: rng.random(3000), "ties": np.round(rng.random(500), 1), "low": rng.random(400) ** 2, "one": np.array([0.3])}
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values], "g string, v double")
    found = {r["g"]: (r["n"], r["d"]) for r in stats.ks_uniform(df, "v", ["g"]).collect()}
    for g, values in groups.items():
        p, i, n = np.sort(values), np.arange(1, len(values) + 1), len(values)
        assert found[g] == (n, np.maximum(i / n - p, p - (i - 1) / n).max())
    assert numbered[0] < sum(map(len, groups.values())) * (1 if cells == 4 else 0.1)


def test_joint_results_read_their_registers(spark, monkeypatch):
    """Estimators read stored registers instead of hashing all elements again, and truths may be given."""
    plans = []

    def estimated(cfg, regs, *rest):
        plans.append(regs._jdf.queryExecution().optimizedPlan().toString())
        raise StopIteration

    monkeypatch.setattr(tables.joint, "joint", estimated)
    rows = spark.range(60).select((F.col("id") % 3).cast("string").alias("key"), F.floor(F.col("id") / 2).alias("x"))
    with pytest.raises(StopIteration):
        tables.joint_results(MinHash(16, scheme="md5"), rows, 1)
    assert "MapInArrow" not in plans[0]
    truth = {(r["k1"], r["k2"]): r["q"]["intersection"] for r in tables.true_joint(rows)[3].collect()}
    sets = {k: {i // 2 for i in range(60) if i % 3 == k} for k in range(3)}
    assert truth == {(str(a), str(b)): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
