"""The simulations and what is plotted from them, as DataFrames."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setforge.config import Registers, SetSketch1, SetSketch2
from setforge.functions import random, scalar
from setforge.functions.hashing import bits
from setforge.operators import cardinality, sketches, stats
from setforge.operators.joint import QUANTITIES, joint
from setforge.sources.grids import example_streams
from setforge.sources.stored import stored


def running_registers(cfg, streams: DataFrame, grid: list[int], most: DataFrame | None = None) -> DataFrame:
    """(example, cardinality, reg, k) of every prefix in ``grid`` of streams (example, i, element); ``most`` (example, most) leaves out those larger than it."""
    cells = F.array(*[F.lit(c).cast("long") for c in grid])
    own = streams.withColumn("cardinality", F.element_at(F.filter(cells, lambda c: c > F.col("i")), 1)).where("cardinality IS NOT NULL")
    chunks = sketches.build(cfg, own, "element", ["example", "cardinality"], kernel=False)
    if most is not None:
        chunks = stored(chunks, "grid-chunks")
    every = chunks.select("example", "reg").distinct()
    if most is not None:
        every = every.join(most, "example")
        cells = F.filter(cells, lambda c: c <= F.col("most"))
    every = every.select("example", "reg", F.explode(cells).alias("cardinality"))
    running = Window.partitionBy("example", "reg").orderBy("cardinality").rowsBetween(Window.unboundedPreceding, 0)
    filled = every.join(chunks, ["example", "cardinality", "reg"], "left")
    return filled.withColumn("k", F.max("k").over(running)).where("k IS NOT NULL").select("example", "cardinality", "reg", "k")


def cardinality_accuracy(spark: SparkSession, cfg, examples: int, grid: list[int], seed: int = 1, scheme: str = "xxhash64") -> DataFrame:
    """(cardinality, estimator, mean, mse, std, kurtosis)."""
    registers = running_registers(cfg, example_streams(spark, examples, max(grid), seed, scheme), [c for c in grid if c])
    found = cardinality.estimates(cfg, registers, ["example", "cardinality"])
    return found.groupBy("cardinality", "estimator").agg(*stats.error_stats(F.col("estimate"), F.col("cardinality")))


def error_series(accuracy: DataFrame, cfg: Registers) -> DataFrame:
    """Relative bias, relative root mean squared error and kurtosis against expectation."""
    n = F.col("cardinality")
    return accuracy.where(n > 0).select(
        "cardinality", "estimator", scalar.relative_error(F.col("mean"), n).alias("bias"), (F.sqrt("mse") / n).alias("rmse"), "kurtosis", scalar.expected_rsd(cfg.b, cfg.m).alias("expected"), F.lit(3.0).alias("normal_kurtosis")
    )


def aligned(series: list[tuple[str, DataFrame]], on: list[str]) -> DataFrame:
    """Tables of several sketches side by side, by true cardinality and estimator."""
    out = None
    for name, df in series:
        df = df.select(*on, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in on))
        out = df if out is None else out.join(df, on)
    return out


def triple_sets(spark: SparkSession, triples: list[tuple[int, int, int]], examples: int, seed: int = 2) -> DataFrame:
    """(example, triple, side, element): both sides of every triple, with the common part in each."""
    wanted = spark.createDataFrame([(i, *t) for i, t in enumerate(triples)], "triple int, d1 bigint, d2 bigint, both bigint")
    rows = wanted.withColumn("example", F.explode(F.sequence(F.lit(0), F.lit(examples - 1))))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d1") + F.col("d2") + F.col("both") - 1)))
    element = F.xxhash64(F.lit(seed), "example", "triple", "i")
    one, two = F.col("i") < F.col("d1") + F.col("both"), F.col("i") >= F.col("d1")
    sides = F.filter(F.array(F.when(one, 1), F.when(two, 2)), lambda s: s.isNotNull())
    return rows.select("example", "triple", element.alias("element"), F.explode(sides).alias("side"))


def joint_accuracy(spark: SparkSession, cfg, triples: list[tuple[int, int, int]], examples: int, seed: int = 2) -> DataFrame:
    """(triple, estimator, quantity, truth, mean, mse) of all twelve quantities and labels."""
    sets = triple_sets(spark, triples, examples, seed)
    key = F.struct("example", "triple", "side")
    registers = sketches.build(cfg, sets.withColumn("key", key), "element", ["key"], kernel=False)
    pairs = spark.range(examples * len(triples)).select((F.col("id") % examples).cast("int").alias("example"), F.floor(F.col("id") / examples).cast("int").alias("triple"))
    side = lambda s: F.struct("example", "triple", F.lit(s).alias("side"))
    wanted = pairs.select(side(1).alias("k1"), side(2).alias("k2"))
    truth = spark.createDataFrame([(i, *t) for i, t in enumerate(triples)], "triple int, d1 bigint, d2 bigint, both bigint")
    known = truth.withColumn("example", F.explode(F.sequence(F.lit(0), F.lit(examples - 1)))).select(F.explode(F.array(F.struct(side(1).alias("key"), (F.col("d1") + F.col("both")).cast("double").alias("estimate")), F.struct(side(2).alias("key"), (F.col("d2") + F.col("both")).cast("double").alias("estimate")))).alias("s")).select("s.*")
    found = joint(cfg, registers, "key", wanted, known).select(F.col("k1.triple").alias("triple"), "estimator", "q")
    from setforge.operators.joint import derived

    actual = truth.select("triple", derived(*(F.col(c).cast("double") for c in ("d1", "d2", "both"))).alias("t"))
    cells = found.join(actual, "triple").select("triple", "estimator", F.explode(F.array(*[F.struct(F.lit(x).alias("quantity"), F.col(f"t.{x}").alias("truth"), F.col(f"q.{x}").alias("value")) for x in QUANTITIES])).alias("c")).select("triple", "estimator", "c.*")
    return cells.groupBy("triple", "estimator", "quantity", "truth").agg(F.avg("value").alias("mean"), stats.mse(F.col("value"), F.col("truth")).alias("mse"))


def joint_series(accuracy: DataFrame, triples: list[tuple[int, int, int]], cfg, spark: SparkSession) -> DataFrame:
    """Relative error of the Jaccard similarity by ratio of the differences, both orientations, with theory."""
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(triples)], "triple int, d1 bigint, d2 bigint, both bigint")
    own = accuracy.where("quantity = 'jaccard' AND truth > 0").join(table, "triple")
    b = getattr(cfg, "b", None) or cfg.effective_base

    def oriented(a: str, c: str) -> DataFrame:
        n1, n2 = F.col(a) + F.col("both"), F.col(c) + F.col("both")
        u = n1 / (n1 + n2)
        return own.where(F.col(c) > 0).select("estimator", "truth", (F.col(a) / F.col(c)).alias("ratio"), (F.sqrt("mse") / F.col("truth")).alias("rmse"), scalar.fisher_rse(b, cfg.m, u, F.col("truth")).alias("theory"), scalar.minhash_relative_rmse(F.col("truth"), cfg.m).alias("minhash"))

    return oriented("d1", "d2").unionByName(oriented("d2", "d1")).distinct().orderBy("estimator", "truth", "ratio")


def bulk_test(cfg: SetSketch1 | SetSketch2, elements: DataFrame, element: str, key: str) -> DataFrame:
    """(key, attempts, differing) of bulk insertion against streaming insertion."""
    bulk, attempts = sketches.bulk(cfg, elements, element, [key])
    stream = sketches.build(cfg, elements, element, [key], kernel=False)
    both = bulk.withColumn("s", F.lit(1)).unionByName(stream.withColumn("s", F.lit(-1)))
    off = both.groupBy(key, "reg", "k").agg(F.sum("s").alias("s")).groupBy(key).agg(F.sum(F.abs("s")).alias("differing"))
    return attempts.join(off, key)


def bulk_series(spark: SparkSession, cfg: SetSketch1 | SetSketch2, sizes: list[int], examples: int, seed: int = 3) -> DataFrame:
    """(cardinality, first_attempt, attempts): how often one attempt is enough, and how many are needed."""
    out = None
    for n in sizes:
        _, attempts = sketches.bulk(cfg, example_streams(spark, examples, n, seed), "element", ["example"])
        row = attempts.agg(F.lit(n).alias("cardinality"), F.avg((F.col("attempts") == 1).cast("double")).alias("first_attempt"), F.avg("attempts").alias("attempts"))
        out = row if out is None else out.unionByName(row)
    return out


def throughput(spark: SparkSession, cfg, sizes: list[int], seed: int = 4) -> DataFrame:
    """(cardinality, seconds, checksum) for building one sketch of each size."""
    from setforge.sources.grids import ids

    rows = []
    for n in sizes:
        began = time.perf_counter()
        total = sketches.checksum(sketches.build(cfg, ids(spark, n, seed), "element", []).withColumn("one", F.lit(1)), ["one"]).collect()
        rows.append((n, time.perf_counter() - began, str(total[0]["checksum"]) if total else "0"))
    return spark.createDataFrame(rows, "cardinality bigint, seconds double, checksum string")


def throughput_series(results: DataFrame, seconds: str = "seconds") -> DataFrame:
    return results.select("cardinality", (F.col(seconds) / F.col("cardinality")).alias("seconds_an_element"))


def samples(rows: DataFrame, element: str, scheme: str, steps: int = 1, kinds: tuple[str, ...] = ("integer", "real", "binomial")) -> DataFrame:
    """(generator, step, kind, cells, value, p) for every generator of ``kinds``, element and step; an element is hashed once a step."""
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    rows = rows.select("step", bits(scheme, F.col(element), F.col("step"), 1, 15).alias("__word"))
    found = []
    for name, (draw, kind, cells, law) in random.GENERATORS.items():
        if kind not in kinds:
            continue
        value = draw("word", F.col("__word"), F.col("step")).cast("double")
        p: Column = law(value) if law else F.lit(None).cast("double")
        found += [F.lit(name), F.lit(kind), F.lit(None if cells is None else float(cells)).cast("double"), value, p]
    # not an array that is exploded, as a filter on its size would hash once more for each draw
    return rows.select("step", F.stack(F.lit(len(found) // 5), *found).alias("generator", "kind", "cells", "value", "p"))


def rng_quality(rows: DataFrame, element: str, scheme: str = "md5", steps: int = 1) -> DataFrame:
    """(generator, step, n, statistic): chi-square, Kolmogorov-Smirnov distance or binomial z."""
    keys = ["generator", "step"]
    counts = samples(rows, element, scheme, steps, ("integer", "binomial")).groupBy(*keys, "kind", "cells", "value").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy(*keys, "kind", "cells").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.sum(F.col("value") * F.col("c")).alias("hits"))
    chi = F.col("squares") * F.col("cells") / F.col("n") - F.col("n")
    z = (F.col("hits") - F.col("n") * F.col("cells")) / F.sqrt(F.col("n") * F.col("cells") * (1 - F.col("cells")))
    counted = per.select(*keys, "n", F.when(F.col("kind") == "integer", chi).otherwise(z).alias("statistic"))
    ks = stats.ks_uniform(samples(rows, element, scheme, steps, ("real",)), "p", keys).withColumnRenamed("d", "statistic")
    return counted.unionByName(ks.select(*keys, "n", "statistic"))


def bit_consistency(rows: DataFrame, element: str, scheme: str = "md5", most: int = 60) -> DataFrame:
    """(bits, n, differing, checksum) for 1 to ``most`` bits: reading n bits at once against reading them one by one, whose values modulo 1009 are summed.

    An element is hashed once, and a task sends a row a number of bits.
    """
    word = F.col("__word")
    hashed = rows.select(bits(scheme, F.col(element), 0, 1, 15).alias("__word"))
    read = hashed.select(random.n_bits("word", word, 0, 60).alias("together"), F.array(*(random.one_bit("word", word, 0, i).cast("tinyint") for i in range(most))).alias("singles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, known = 0, 0
        differing, checksum = np.zeros(most, np.int64), np.zeros(most, np.int64)
        for batch in batches:
            n += batch.num_rows
            batch = batch.filter(batch.column(0).is_valid())
            known += batch.num_rows
            together = batch.column(0).to_numpy()
            singles = np.ascontiguousarray(batch.column(1).flatten().to_numpy().reshape(-1, most).T)
            single = np.zeros(len(together), np.int64)
            for i in range(most):
                single = single * 2 + singles[i]
                differing[i] += np.count_nonzero(together >> (59 - i) != single)
                checksum[i] += (single % 1009).sum()
        if n:
            none = np.full(most, not known)  # as sums of nothing are
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, most + 1, dtype=np.int32)), pa.array(np.full(most, n)), pa.array(differing, mask=none), pa.array(checksum, mask=none)], names=["bits", "n", "differing", "checksum"])

    checks = read.mapInArrow(run, "bits int, n bigint, differing bigint, checksum bigint")
    return checks.groupBy("bits").agg(*(F.sum(c).alias(c) for c in ("n", "differing", "checksum")))
