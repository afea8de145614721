"""Building, merging and describing sketches as rows (keys..., reg, k).

The rows are sparse: a register that no element touched has no row.  Building is
one partially aggregated maximum, so a key with most of the rows costs at most m
rows a task, and merging is the same maximum over unions of sketches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.config import HyperLogLog, Registers, SetSketch1, SetSketch2, SketchFamily, same
from setforge.operators import digests, families, scan
from setforge.operators.families import best
from setforge.operators.keyed import join_on
from setforge.operators.points import register_value, setsketch1_points, setsketch2_points, updates, within
from setforge.sources.stored import stored


def build(cfg: SketchFamily, df: DataFrame, element: str, keys: list[str], kernel: bool | None = None) -> DataFrame:
    """The sketch of the elements of each key; ``kernel`` selects the Arrow path, by default for the marked scheme, wide SetSketch1 and MinHash."""
    from setforge.operators import kernels

    if kernel is None:
        kernel = families.by_kernel(cfg)
    if kernel:
        return kernels.partial_registers(cfg, df, element, keys).groupBy(*keys, "reg").agg(best(cfg))
    return updates(cfg, df, element, keys).groupBy(*keys, "reg").agg(best(cfg)).where(F.col("k") != families.empty(cfg))


def merge(cfg: SketchFamily, sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Union of all sketches with the same keys."""
    return sketches.groupBy(*keys, "reg").agg(best(cfg))


def merge_two(first_cfg: SketchFamily, first: DataFrame, second_cfg: SketchFamily, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two sketch tables; raises where configurations differ."""
    same(first_cfg, second_cfg)
    return merge(first_cfg, first.unionByName(second), keys)


def grouping_sets(cfg: SketchFamily, sketches: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """(keys..., level, reg, k) for every grouping set, merged from the sketches by all ``keys``.

    Elements are read once, for the finest grain.  ``level`` has a bit for each key,
    the first key's highest, that is 1 where the set leaves the key out, which tells
    such rows from those of a null key.
    """
    marks = [F.grouping(k).cast("int") * (1 << len(keys) - 1 - i) for i, k in enumerate(keys)]
    level = sum(marks[1:], marks[0]).alias("level")
    found = sketches.groupingSets([[*(F.col(k) for k in s), F.col("reg")] for s in sets], *keys, "reg").agg(level, best(cfg))
    return found.select(*keys, "level", "reg", "k")


def rollup(cfg: SketchFamily, sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Grouping sets of the first keys, from all to none."""
    return grouping_sets(cfg, sketches, keys, [keys[:n] for n in range(len(keys), -1, -1)])


def cube(cfg: SketchFamily, sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Grouping sets of every choice of keys."""
    return grouping_sets(cfg, sketches, keys, [[k for i, k in enumerate(keys) if n >> i & 1] for n in range(1 << len(keys))])


def dense(cfg: SketchFamily, sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., registers array): m values, 0 (MinHash: the span) where nothing was added."""
    empty = families.empty(cfg)
    held = sketches.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("reg", "k"))).alias("held"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(cfg.m - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(empty))).alias("registers"))


def histogram(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., k, c) of the registers that were touched."""
    return sketches.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("c"))


def minimum(cfg: SketchFamily, sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest register by key; 0 while some register is untouched."""
    return sketches.groupBy(*keys).agg(F.when(F.count(F.lit(1)) < cfg.m, 0).otherwise(F.min("k")).alias("minimum"))


def checksum(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.sum(F.col("k").cast("decimal(38,0)")).cast("decimal(38,0)").alias("checksum"))


def prefixes(cfg: Registers, df: DataFrame, element: str, keys: list[str], order: str, every: int) -> DataFrame:
    """(keys..., prefix, reg, k): the sketch of the first prefix x ``every`` elements in order.

    Each chunk of ``every`` elements is sketched, then a running maximum by
    register takes the place of a running sketch.  Both the elements' numbers and
    the maxima are scans over ranges, so no task holds a whole key.
    """
    rows = scan.numbered(df, keys, [order], "__row")
    chunked = rows.withColumn("prefix", F.floor((F.col("__row") - 1) / every).cast("long") + 1).drop("__row")
    chunks = build(cfg, chunked, element, [*keys, "prefix"])
    ends = chunked.select(*keys, "prefix").distinct()
    everywhere = ends.withColumn("reg", F.explode(F.sequence(F.lit(0), F.lit(cfg.m - 1))))
    # a union and a grouped maximum instead of an outer join, which would lose null keys
    filled = everywhere.withColumn("k", F.lit(None).cast(chunks.schema["k"].dataType)).unionByName(chunks).groupBy(*keys, "prefix", "reg").agg(F.max("k").alias("k"))
    found = scan.running(filled, [*keys, "reg"], ["prefix"], "k", "max", "__k")
    return found.where("__k IS NOT NULL").select(*keys, "prefix", "reg", F.col("__k").alias("k"))


def compose(cfg: SketchFamily, powers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sketches of n elements from sketches of 2^e elements: powers (e, reg, k), wanted (n).

    The powers are 63 m registers at most, which go to every task, so that a row of
    ``wanted`` turns into its registers where it lies.
    """
    import numpy as np
    import pyarrow as pa

    least, empty = families.keeps(cfg) == "min", families.empty(cfg)
    held = np.full((63, cfg.m), empty, np.int64)
    for e, reg, k in powers.where(F.col("e").between(0, 62)).select("e", "reg", "k").collect():
        held[e, reg] = k
    kind = powers.schema["k"].dataType
    dtype, better = np.int32 if kind.typeName() == "integer" else np.int64, np.minimum if least else np.maximum

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                n = batch.column(0).to_numpy()[lo : lo + 1000]
                found = np.full((len(n), cfg.m), empty, np.int64)
                for e in range(63):
                    has = np.flatnonzero(n >> e & 1)
                    if len(has):
                        found[has] = better(found[has], held[e])
                row, reg = np.nonzero(found != empty)
                yield pa.RecordBatch.from_arrays([pa.array(n[row]), pa.array(reg.astype(np.int32)), pa.array(found[row, reg].astype(dtype))], names=["n", "reg", "k"])

    distinct = wanted.select(F.col("n").cast("bigint")).where("n IS NOT NULL").distinct()
    return distinct.mapInArrow(run, f"n bigint, reg int, k {kind.simpleString()}")


# ---- bulk insertion -------------------------------------------------------


def first_limit(cfg: Registers, n: Column, success: float = 0.95) -> Column:
    """Bound on points that suffices with probability ``success`` for n elements."""
    return F.lit(-math.log1p(-(success ** (1 / cfg.m)))) / (F.lit(float(cfg.a)) * n)


#: The sketch that counts elements for first limits, and its relative standard error.
COUNTING = HyperLogLog(256, 2.0, 52)
COUNT_ERROR = 1.04 / COUNTING.m**0.5
#: What each further attempt multiplies the limit by; the last one has no limit.
GROWTH, ATTEMPTS = 4.0, 3


def bulk(cfg: SetSketch1 | SetSketch2, df: DataFrame, element: str, keys: list[str], success: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Sketches (keys..., reg, k) from small points only, and (keys..., attempts).

    One scan counts each key's distinct elements with a sketch of fixed size; two
    standard errors below that count, the first limit suffices with probability
    ``success`` however often elements repeat.  A key is done when its smallest
    register exceeds what any further point could give.  The keys that are not go
    through the input again, alone, with a larger limit, and the third time without
    one; so there are ``ATTEMPTS`` scans at most besides the counting.  With the
    ``marked`` scheme only points up to the limit are drawn.
    """
    from setforge.operators import cardinality, kernels

    rows = df.where(F.col(element).isNotNull()).select(*keys, F.col(element).alias("__element"))
    sizes = cardinality.simple(COUNTING, build(COUNTING, rows, "__element", keys, kernel=False), keys).where("estimate > 0")
    least = F.greatest(F.lit(1.0), F.floor(F.col("estimate") * (1 - 2 * COUNT_ERROR)))
    open_ = sizes.select(*keys, first_limit(cfg, least, success).alias("limit"))
    if keys:
        open_ = stored(open_, "bulk-limits")
    else:  # one row
        first = open_.first()
        limit = first["limit"] if first else None
    done = open_.select(*keys, F.lit(0).alias("reg"), F.lit(0).alias("k")).limit(0)
    tried = open_.select(*keys, F.lit(0).alias("attempts")).limit(0)
    # points above 1 give a register 0, and so does a limit of b
    for turn in range(1, ATTEMPTS + 1):
        if turn == ATTEMPTS:
            open_ = open_.withColumn("limit", F.lit(float(cfg.b)))
        if keys:
            limited = join_on(rows, open_, keys)
        elif limit is None:
            break
        else:
            limited = rows.withColumn("limit", F.lit(float(cfg.b) if turn == ATTEMPTS else limit))
        if cfg.scheme == "marked":
            small = kernels.partial_registers(cfg, limited, "__element", keys, limit="limit")
        elif cfg.scheme == "md5":
            small = digests.updates(cfg, limited, "__element", keys, limit="limit")
        else:
            limited = digests.clustered(limited, "__element", [*keys, "limit"])
            points = setsketch1_points(cfg, limited, "__element") if isinstance(cfg, SetSketch1) else setsketch2_points(cfg, limited, "__element")
            small = points.where(within(F.col("x"), F.col("limit"))).withColumn("k", register_value(F.col("x"), cfg.b, cfg.q))
        small = stored(small.groupBy(*keys, "limit", "reg").agg(F.max("k").alias("k")), "bulk-registers")
        lowest = small.groupBy(*keys, "limit").agg(F.when(F.count(F.lit(1)) < cfg.m, 0).otherwise(F.min("k")).alias("lowest"))
        enough = F.lit(True) if turn == ATTEMPTS else register_value(F.col("limit"), cfg.b, cfg.q) <= F.col("lowest")
        ready = lowest.where(enough).select(*keys, F.lit(turn).alias("attempts"))
        if not keys:
            if not ready.isEmpty():
                return small.where("k > 0").select("reg", "k"), ready
            limit *= GROWTH
            continue
        whole = join_on(small, ready, keys, "left_semi")
        done, tried = done.unionByName(whole.where("k > 0").select(*keys, "reg", "k")), tried.unionByName(ready)
        open_ = join_on(open_, ready, keys, "left_anti").withColumn("limit", F.col("limit") * GROWTH)
        if turn == ATTEMPTS or open_.isEmpty():
            break
    return done, tried
