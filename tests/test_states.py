"""Scans over ranges, bulk insertion, packed states, similarity search, families from elsewhere, grouping sets."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setforge.config import GeneralizedHyperLogLog, HyperLogLog, HyperMinHash, MinHash, SetSketch1, SetSketch2
from setforge.operators import cardinality, joint, kernels, packed, scan, similarity, sketches, stats
from setforge.sources import stored


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as many as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- scans ------------------------------------------------------------------


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), rng.randrange(40), rng.choice([None, *range(9)])) for _ in range(4000)]
    return rows, spark.createDataFrame(rows, "key string, at int, v int").repartition(6)


def test_a_key_spans_many_ranges(many_ranges, events):
    sizes = scan.ordered(events[1], ["key"], ["at"]).groupBy("key", "__part").count().where("key = 'hot'").collect()
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) < 1000


def test_numbers(many_ranges, events):
    rows, df = events
    found = scan.numbered(df, ["key"], ["at"], "i", "n").collect()
    by_key = {}
    for r in found:
        by_key.setdefault(r["key"], []).append(r)
    for key, own in by_key.items():
        own.sort(key=lambda r: r["i"])
        assert [r["i"] for r in own] == list(range(1, len(own) + 1))
        assert all(r["n"] == len(own) for r in own)
        assert [r["at"] for r in own] == sorted(at for k, at, _ in rows if k == key)


@pytest.mark.parametrize("how, whole", [("sum", sum), ("max", max), ("min", min)])
def test_running(many_ranges, spark, how, whole):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", None]), i, rng.choice([None, *range(50)])) for i in range(1500)]
    found = scan.running(spark.createDataFrame(rows, "key string, i int, v int"), ["key"], ["i"], "v", how, "w").collect()
    want = {}
    for key in ("a", None):
        seen = []
        for k, i, v in rows:
            if k == key:
                seen += [] if v is None else [v]
                want[i] = whole(seen) if seen else None
    assert {r["i"]: r["w"] for r in found} == want


def test_scans_of_nothing(spark):
    none = spark.createDataFrame([], "key string, i int, v int")
    assert scan.numbered(none, ["key"], ["i"], "n").collect() == []
    assert scan.running(none, [], ["i"], "v", "sum", "s").collect() == []


def test_prefixes_of_one_key(many_ranges, spark):
    cfg = GeneralizedHyperLogLog(32, 2.0, 62)
    df = spark.range(1000).select(F.lit("one").alias("key"), "id")
    found = sketches.prefixes(cfg, df, "id", ["key"], "id", 150).where("prefix = 4")
    assert rows_of(found.select("key", "reg", "k")) == rows_of(sketches.build(cfg, df.where("id < 600"), "id", ["key"]))


def test_distance_from_uniform(many_ranges, spark):
    rng = np.random.default_rng(4)
    x = np.sort(np.round(rng.random(900) ** 1.1, 2))
    want = max(max((i + 1) / 900 - v, v - i / 900) for i, v in enumerate(x))
    got = stats.ks_uniform(spark.createDataFrame([(1, float(v)) for v in x], "k int, v double"), "v", ["k"]).first()
    assert got["n"] == 900 and got["d"] == pytest.approx(want)


def test_stored_tables_are_freed(spark):
    with stored.freed():
        df = stored.stored(spark.range(5), "probe")
        path = df.inputFiles()[0]
        assert df.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


# ---- bulk insertion -----------------------------------------------------------


@pytest.mark.parametrize("cfg", [SetSketch1(64), SetSketch2(64), SetSketch1(64, scheme="marked")])
def test_bulk_of_repeated_elements(spark, cfg):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    ids = spark.range(1000).select(F.when(F.col("id") < 700, "most").when(F.col("id") < 703, "few").alias("key"), "id")
    df = ids.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("again")
    bulk, attempts = sketches.bulk(cfg, df, "id", ["key"])
    assert rows_of(bulk.select("key", "reg", "k")) == rows_of(sketches.build(cfg, ids, "id", ["key"]).select("key", "reg", "k"))
    tried = {r["key"]: r["attempts"] for r in attempts.collect()}
    assert set(tried) == {"most", "few", None} and max(tried.values()) <= sketches.ATTEMPTS
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_bulk_with_hopeless_limits(spark):
    """Limits that never suffice end in a last attempt without one."""
    cfg = SetSketch1(64)
    df = spark.range(300).select((F.col("id") % 2).alias("key"), "id")
    bulk, attempts = sketches.bulk(cfg, df, "id", ["key"], success=1e-300)
    assert rows_of(bulk.select("key", "reg", "k")) == rows_of(sketches.build(cfg, df, "id", ["key"]).select("key", "reg", "k"))
    assert {r["attempts"] for r in attempts.collect()} <= {1, 2, 3}
    whole, once = sketches.bulk(cfg, df, "id", [])
    assert rows_of(whole.select("reg", "k")) == rows_of(sketches.build(cfg, df, "id", []).select("reg", "k")) and once.count() == 1
    assert sketches.bulk(cfg, df.limit(0), "id", [])[0].collect() == sketches.bulk(cfg, df.limit(0), "id", ["key"])[0].collect() == []


# ---- kernels and likelihood ------------------------------------------------------


def test_kernels_with_more_keys_than_blocks(spark, monkeypatch):
    cfg = GeneralizedHyperLogLog(16, 2.0, 62, scheme="marked")
    df = spark.range(3000).select((F.col("id") % 700).alias("a"), F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("string")).alias("b"), "id")
    got = sketches.build(cfg, df, "id", ["a", "b"])
    block = kernels.block(cfg)
    one = df.where("a = 5 AND b = '5'").select(kernels.element_id(df, "id").alias("h")).collect()
    block.add(np.array([r["h"] for r in one], np.int64).view(np.uint64))
    reg, k = block.rows()
    assert sorted((r["reg"], r["k"]) for r in got.where("a = 5 AND b = '5'").collect()) == sorted(zip(reg.tolist(), k.tolist()))
    assert got.select("a", "b").distinct().count() == df.select("a", "b").distinct().count()


def test_likelihoods_of_many_sketches_at_once():
    rng = np.random.default_rng(8)
    for cfg in (HyperLogLog(64, 2.0, 20), SetSketch1(64, 1.2, 40, 20.0)):
        values = [rng.integers(0, cfg.q + 2, cfg.m) // s for s in (1, 2, 5)] + [np.zeros(cfg.m, int), np.full(cfg.m, cfg.q + 1)]
        counts = [np.bincount(v, minlength=cfg.q + 2) for v in values]
        together = cardinality.ml_from_histograms(cfg, [np.flatnonzero(c) for c in counts], [c[c > 0] for c in counts])
        for found, c in zip(together, counts):
            assert found == pytest.approx(cardinality.ml_from_counts(cfg, c))
            if 0 < found < math.inf:  # a little more or less is less likely
                assert likelihood(cfg, c, found) >= max(likelihood(cfg, c, found * 1.01), likelihood(cfg, c, found * 0.99))


def likelihood(cfg, counts, n):
    k = np.arange(cfg.q + 2.0)
    top, bottom = np.exp(-n * cfg.rate * cfg.b**-k), np.exp(-n * cfg.rate * cfg.b ** (1 - k))
    if cfg.range_correction:
        top[-1], bottom[0] = 1.0, 0.0
    return float((counts * np.log(np.maximum(top - bottom, 1e-300))).sum())


# ---- dispatch of joint estimates ----------------------------------------------------


def test_dispatch_by_extreme_registers(spark):
    """Plain, untouched in both, saturated in both, both of these: each with the options that reach it."""
    cfg = GeneralizedHyperLogLog(64, 2.0, 6)
    rows = [(1, 2, 60.0, 50.0, 90.0, 12, 10, 42, 0, 0), (1, 3, 30.0, 40.0, 55.0, 10, 14, 40, 9, 0), (1, 4, 300.0, 400.0, 500.0, 10, 14, 40, 0, 5), (1, 5, 90.0, 80.0, 120.0, 10, 14, 40, 3, 2)]
    compared = spark.createDataFrame(rows, "k1 int, k2 int, n1 double, n2 double, union double, d_plus long, d_minus long, d_equal long, both_zero long, both_top long")

    def found(*options):
        return {r["k2"]: r["q"]["jaccard"] for r in joint.joint_new(cfg, compared, *options).collect()}

    plain, corrected, fallback, both = found(), found(True), found(False, True), found(True, True)
    own = {r["k2"]: r["q"]["jaccard"] for r in joint.joint_incl_excl(compared).collect()}
    assert corrected[3] != plain[3] and {k: corrected[k] for k in (2, 4, 5)} == {k: plain[k] for k in (2, 4, 5)}
    assert fallback[2] == plain[2] and all(fallback[k] == own[k] for k in (3, 4, 5))
    assert both == {2: plain[2], 3: corrected[3], 4: own[4], 5: own[5]}
    with pytest.raises(ValueError):
        joint.joint_new(cfg, compared.drop("union"), incl_excl_fallback=True)


# ---- packed states ---------------------------------------------------------------------

PACKED = [HyperLogLog(64, 2.0, 58), GeneralizedHyperLogLog(37, 1.2, 254), GeneralizedHyperLogLog(33, 1.001, 65534), SetSketch1(20, 2.0, 0, 1.0), SetSketch2(16, 2.0, 62), MinHash(24), HyperMinHash(4, 5, 3), HyperMinHash(5, 6, 20)]


@pytest.mark.parametrize("cfg", PACKED, ids=lambda c: f"{c.name}-{c.m}")
def test_packing_round_trip(cfg):
    rng = np.random.default_rng(1)
    most = packed.empty(cfg) or (1 << packed.width(cfg)) - 1
    registers = rng.integers(0, most + 1, (7, cfg.m))
    states = packed.to_states(cfg, registers)
    assert all(len(s) == packed.size(cfg) == len(packed.header(cfg)) + math.ceil(cfg.m * packed.width(cfg) / 8) for s in states)
    assert (packed.from_states(cfg, states) == registers).all()
    assert packed.info(states[0]) == cfg.info()
    assert packed.to_states(cfg, registers[:0]) == [] and packed.from_states(cfg, []).shape == (0, cfg.m)


@pytest.mark.parametrize("cfg", PACKED, ids=lambda c: f"{c.name}-{c.m}")
def test_packed_states_in_tables(spark, cfg):
    df = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("key"), (F.col("id") % 2).alias("part"), (F.col("id") % 400).alias("x"))
    parts = sketches.build(cfg, df, "x", ["key", "part"], kernel=False)
    whole = sketches.build(cfg, df, "x", ["key"], kernel=False)
    states = packed.merge_packed(cfg, packed.pack(cfg, parts, ["key", "part"]), ["key"])
    assert rows_of(packed.unpack(cfg, states, ["key"])) == rows_of(whole.select("key", "reg", "k"))
    assert rows_of(packed.unpack(cfg, packed.merge_packed(cfg, states, []), [])) == rows_of(sketches.build(cfg, df, "x", [], kernel=False).select("reg", "k"))
    want = {r["key"]: r["estimate"] for r in cardinality.own(cfg)(cfg, whole, ["key"]).collect()}
    got = {r["key"]: r["n"] for r in states.select("key", packed.estimate(cfg, F.col("state")).alias("n")).collect()}
    assert got == pytest.approx(want)
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "k1 long, k2 long")
    kept = ["k1", "k2", *packed.COMPARED]
    assert rows_of(packed.pairs_packed(cfg, states, "key", pairs).select(*kept)) == rows_of(joint.pairs(cfg, whole, "key", pairs).select(*kept))


def test_packed_states_of_other_configurations(spark):
    one, two = GeneralizedHyperLogLog(16), GeneralizedHyperLogLog(16, scheme="md5")
    states = packed.pack(one, sketches.build(one, spark.range(9).withColumn("key", F.lit(1)), "id", ["key"]), ["key"])
    with pytest.raises(Exception, match="not of"):
        packed.merge_packed(two, states, ["key"]).collect()
    with pytest.raises(ValueError):
        packed.info(b"other bytes")


@pytest.mark.parametrize("cfg", [GeneralizedHyperLogLog(32, scheme="marked"), SetSketch1(32, scheme="marked"), MinHash(16)], ids=lambda c: c.name)
def test_packed_building(spark, cfg):
    df = spark.range(2000).select((F.col("id") % 5).alias("key"), "id").repartition(4)
    assert rows_of(packed.unpack(cfg, packed.build_packed(cfg, df, "id", ["key"]), ["key"])) == rows_of(sketches.build(cfg, df, "id", ["key"], kernel=True).select("key", "reg", "k"))


# ---- similarity search -------------------------------------------------------------------


@pytest.fixture(scope="module")
def sets():
    """Sets in groups around a common core, some equal, most unrelated."""
    rng, out = random.Random(3), []
    for group in range(25):
        core = [f"g{group}-{i}" for i in range(200)]
        for j in range(4):
            own = rng.sample(core, 200 - 8 * j) + [f"s{group}-{j}-{i}" for i in range(10 * j)]
            out.append(set(own))
    out += [set(out[0]), set(out[0]), set(out[5])]
    return out


@pytest.fixture(scope="module")
def members(spark, sets):
    return spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "key int, x string").repartition(4).persist()


@pytest.mark.parametrize("cfg", [SetSketch1(256, 1.001, 65534), MinHash(256), HyperMinHash(11, 6, 10)], ids=lambda c: c.name)
def test_similar_sets_are_found(spark, members, sets, cfg):
    # many elements a register are needed where each element updates one register only
    factor = 1 if not isinstance(cfg, HyperMinHash) else 60
    df = members.withColumn("x", F.explode(F.transform(F.sequence(F.lit(1), F.lit(factor)), lambda i: F.concat("x", F.lit("|"), i.cast("string")))))
    found = similarity.similar(cfg, sketches.build(cfg, df, "x", ["key"], kernel=False), "key", 0.6)
    of = {r["key"]: r["class"] for r in found.members.collect()}
    assert of[100] == of[101] == of[0] == 0 and of[102] == of[5]
    links = {(r["k1"], r["k2"]): r["jaccard"] for r in found.links.collect()}
    assert all(a < b and of[a] == a and of[b] == b for a, b in links)
    exact = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(set(of.values())), 2)}
    wanted = [p for p, j in exact.items() if j >= 0.7]
    assert len(wanted) > 50 and sum(p in links for p in wanted) >= 0.9 * len(wanted)
    assert all(exact[p] > 0.4 for p in links)


def test_hot_bands_are_split(spark, members):
    cfg = SetSketch1(64, 2.0, 62)
    keys = similarity.band_keys(cfg, sketches.build(cfg, members, "x", ["key"]), "key", 2)
    one, many = similarity.candidates(keys, "key"), similarity.candidates(keys, "key", block=3)
    assert rows_of(one) == rows_of(many) and one.count() > 100
    plan = one._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bands_for_a_recall():
    cfg = MinHash(256)
    rows = similarity.band_rows(cfg, 0.8, 0.95)
    chance = lambda r: 1 - (1 - 0.8**r) ** (256 // r)
    assert chance(rows) >= 0.95 > chance(rows + 1)
    assert similarity.band_rows(cfg, 0.0, 0.9) == 1


def test_similarity_of_nothing(spark):
    cfg = MinHash(16)
    found = similarity.similar(cfg, sketches.build(cfg, spark.createDataFrame([], "key int, x string"), "x", ["key"]), "key", 0.5)
    assert found.links.collect() == found.members.collect() == []


# ---- a family from elsewhere ----------------------------------------------------------------


def linear_counting(size):
    """A bit for each hash value; what the library knows of it is here."""

    class LinearCounting:
        name, bits, m = "LinearCounting", 1, size

        def info(self):
            return {"name": self.name, "m": str(self.m)}

        def points(self, rows, element, keys):
            return rows.select(*keys, F.pmod(F.xxhash64(element), F.lit(self.m)).cast("int").alias("reg"), F.lit(1).alias("k"))

        def estimators(self):
            return {"linear": lambda cfg, df, keys: df.groupBy(*keys).agg((-F.ln(F.lit(1.0) - F.count(F.lit(1)) / (cfg.m + 1.0)) * cfg.m).alias("estimate"))}

    return LinearCounting()


def test_a_family_from_elsewhere(spark):
    cfg = linear_counting(4096)
    df = spark.range(1500).select(F.explode(F.array(*(F.struct(F.lit(n).alias("key"), (F.col("id") + o).alias("x")) for n, o in (("a", 0), ("b", 500))))).alias("s")).select("s.*")
    regs = sketches.build(cfg, df, "x", ["key"])
    estimates = {(r["key"], r["estimator"]): r["estimate"] for r in cardinality.estimates(cfg, regs, ["key"]).collect()}
    assert all(abs(n / 1500 - 1) < 0.05 for n in estimates.values()) and set(estimates) == {("a", "linear"), ("b", "linear")}
    both = sketches.merge(cfg, regs.withColumn("key", F.lit("all")), ["key"])
    assert abs(cardinality.estimates(cfg, both, ["key"]).first()["estimate"] / 2000 - 1) < 0.05
    wanted = spark.createDataFrame([("a", "b")], "k1 string, k2 string")
    found = joint.joint(cfg, regs, "key", wanted).collect()
    assert [r["estimator"] for r in found] == ["inclExcl"] and abs(found[0]["q"]["jaccard"] - 0.5) < 0.07
    states = packed.pack(cfg, regs, ["key"])
    assert rows_of(packed.unpack(cfg, states, ["key"])) == rows_of(regs)
    assert states.select(F.length("state").alias("n")).first()["n"] == len(packed.header(cfg)) + 512
    with pytest.raises(ValueError):
        sketches.build(cfg, df, "x", ["key"], kernel=True)


# ---- grouping sets ------------------------------------------------------------------------


def test_grouping_sets_tell_null_keys_from_left_out_ones(spark):
    cfg = GeneralizedHyperLogLog(16)
    df = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"), "id")
    finest = sketches.build(cfg, df, "id", ["a", "b"])
    found = sketches.cube(cfg, finest, ["a", "b"])
    assert rows_of(found.where("level = 1").select("a", "reg", "k")) == rows_of(sketches.build(cfg, df, "id", ["a"]))
    assert rows_of(found.where("level = 2").select("b", "reg", "k")) == rows_of(sketches.build(cfg, df, "id", ["b"]))
    assert rows_of(found.where("level = 3").select("reg", "k")) == rows_of(sketches.build(cfg, df, "id", []))
    assert rows_of(sketches.rollup(cfg, finest, ["a", "b"])) == rows_of(found.where("level <> 2"))
