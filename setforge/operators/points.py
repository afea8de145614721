"""From elements to register updates.

Every family is an expression, or a short plan, that turns rows (keys..., element)
into rows (keys..., reg, k).  Building a sketch is then the maximum (MinHash: the
minimum) of k by keys and register; see ``sketches``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.config import GeneralizedHyperLogLog, HyperLogLog, HyperMinHash, MinHash, Registers, SetSketch1, SetSketch2
from setforge.functions.hashing import bits, unit
from setforge.operators import digests, families


def register_value(x: Column, b: float, q: int) -> Column:
    """Value a point x > 0 gives a register: x in (b^-k, b^-(k-1)] gives k, limited to 0 .. q+1."""
    return F.greatest(F.lit(0), F.least(F.lit(q + 1), F.floor(1 - F.ln(x) / F.lit(math.log(b))).cast("int")))


def is_relevant(x: Column, lowest: Column, b: float, q: int) -> Column:
    """Can a point still raise a register when none is below ``lowest``?"""
    return (x <= 0) | ((lowest <= q) & (x <= F.pow(F.lit(b), -lowest)))


def within(x: Column, limit: Column | None) -> Column:
    """The stop condition of a bulk insertion; no limit lets every point through."""
    return F.lit(True) if limit is None else x <= limit


def trailing_ones(h: Column) -> Column:
    return F.bit_count(h.bitwiseXOR(h + 1)) - 1


def hll_update(cfg: HyperLogLog, x: Column) -> tuple[Column, Column]:
    """Register from the leading bits of a 60-bit hash, value from its trailing ones."""
    h = bits(cfg.scheme, x, None, 1, 15)
    return F.shiftrightunsigned(h, 60 - cfg.p).cast("int"), F.least(trailing_ones(h) + 1, F.lit(cfg.q + 1)).cast("int")


def ghll_update(cfg: GeneralizedHyperLogLog, x: Column) -> tuple[Column, Column]:
    reg = F.pmod(bits(cfg.scheme, x, None, 1, 8), F.lit(cfg.m)).cast("int")
    return reg, register_value(unit(cfg.scheme, x, None), cfg.b, cfg.q)


def hyperminhash_update(cfg: HyperMinHash, x: Column) -> tuple[Column, Column]:
    value = F.least(trailing_ones(bits(cfg.scheme, x, None, 1, 15)) + 1, F.lit(1 << cfg.bucket_size))
    reg = F.pmod(bits(cfg.scheme, x, None, 16, 5), F.lit(cfg.m)).cast("int")
    low = F.pmod(bits(cfg.scheme, x, None, 22, 6), F.lit(1 << cfg.sub_bits))
    return reg, F.shiftleft(value.cast("int"), cfg.sub_bits).bitwiseOR(low.cast("int"))


def exponential(cfg: Registers, x: Column, reg: Column) -> Column:
    """The point of an element for a register: exponential with rate a."""
    return -F.ln(unit(cfg.scheme, x, reg)) / F.lit(float(cfg.a))


def _each_register(df: DataFrame, m: int) -> DataFrame:
    return df.withColumn("reg", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))


def setsketch1_points(cfg: SetSketch1, df: DataFrame, element: str) -> DataFrame:
    """Ascending points assigned by a random permutation are independent exponentials by register."""
    return _each_register(df, cfg.m).withColumn("x", exponential(cfg, F.col(element), F.col("reg")))


def setsketch2_points(cfg: SetSketch2, df: DataFrame, element: str) -> DataFrame:
    """One point in each of m strata of equal exponential mass; a random order deals strata to registers, inside an element's row."""
    order = lambda reg: F.struct(bits(cfg.scheme, F.col(element), reg, 23, 8).alias("at"), reg.alias("reg"))
    dealt = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(cfg.m - 1)), order))
    rows = df.select("*", F.posexplode(dealt).alias("stratum", "__dealt")).withColumn("reg", F.col("__dealt.reg")).drop("__dealt")
    share = (F.col("stratum") + unit(cfg.scheme, F.col(element), F.col("reg"))) / F.lit(float(cfg.m))
    return rows.withColumn("x", -F.log1p(-share) / F.lit(float(cfg.a))).drop("stratum")


def _rows(df: DataFrame, element: str, keys: list[str]) -> DataFrame:
    return df.where(F.col(element).isNotNull()).select(*keys, element)


@families.updates.register
def _minhash_updates(cfg: MinHash, df: DataFrame, element: str, keys: list[str], limit: Column | None = None) -> DataFrame:
    rows = _rows(df, element, keys)
    if cfg.scheme == "md5":
        return digests.updates(cfg, rows, element, keys)
    every = _each_register(digests.clustered(rows, element, keys), cfg.m)
    return every.select(*keys, "reg", bits(cfg.scheme, F.col(element), F.col("reg"), 1, 15).alias("k"))


@families.updates.register(SetSketch1)
@families.updates.register(SetSketch2)
def _setsketch_updates(cfg: SetSketch1 | SetSketch2, df: DataFrame, element: str, keys: list[str], limit: Column | None = None) -> DataFrame:
    """These families touch every register, so each distinct element is taken once, and a key's elements lie together."""
    rows = _rows(df, element, keys)
    if cfg.scheme == "md5" and limit is None:
        return digests.updates(cfg, rows, element, keys)
    rows = digests.clustered(rows, element, keys)
    points = setsketch1_points(cfg, rows, element) if isinstance(cfg, SetSketch1) else setsketch2_points(cfg, rows, element)
    return points.where(within(F.col("x"), limit)).select(*keys, "reg", register_value(F.col("x"), cfg.b, cfg.q).alias("k"))


def _one_update(find):
    def found(cfg, df: DataFrame, element: str, keys: list[str], limit: Column | None = None) -> DataFrame:
        reg, k = find(cfg, F.col(element))
        return _rows(df, element, keys).select(*keys, reg.alias("reg"), k.alias("k"))

    return found


for _kind, _find in ((HyperLogLog, hll_update), (GeneralizedHyperLogLog, ghll_update), (HyperMinHash, hyperminhash_update)):
    families.updates.register(_kind, _one_update(_find))
updates = families.updates
families.keeps.register(MinHash, lambda cfg: "min")
families.empty.register(MinHash, lambda cfg: cfg.span)


def hyperminhash_to_ghll(cfg: HyperMinHash, k: Column) -> Column:
    """Register value of the generalized HyperLogLog sketch with the effective base."""
    top = cfg.as_ghll().q + 1
    return F.when(k == 0, 0).otherwise(F.least(k - ((1 << cfg.sub_bits) - 1), F.lit(top))).cast("int")


def hyperminhash_to_hll(cfg: HyperMinHash, k: Column) -> Column:
    return F.shiftright(k, cfg.sub_bits)
