"""Mixing sources to target weights by entropy balancing.

Among all document rates r between 0 and ``most`` with sum(size * r) equal to each
source's target, the mix takes the one closest to 1 in relative entropy.  Its dual
is convex in one number l a source, and the rates are exponential tilts by size,
min(most, exp(l * size)).  Newton steps solve all duals together, kept inside
brackets that the smallest size gives.  Rates are then rounded into whole copies by
error diffusion inside bounded buckets of a source, so that what a source takes
differs from its target by about the size of a few of its smallest documents.

Scale: sizes are written once; Newton steps run over the numbers of documents by
source and size.  Sources, their ranks, targets and duals stay in the cluster; the
driver sees sums and one number for each partition of sources.  Buckets come from a
hash of the row and hold about ``BUCKET`` documents each, so a source with a third
of all rows is as many buckets.

Defined cases: null text has size 0 and is taken 0 times; the null source is a
source of its own, last in order; equal rows are rounded separately; sources
without words have target 0; an empty table gives an empty result; the result
depends on the rows alone, not on their partitioning; a text of any length counts
only by its number of words; ``mix`` neither reads nor returns other columns, and
``repeat`` returns all columns of its input under their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setforge.llm.shared import Shelf, free_name

WORD = r"[^\x20\x09-\x0D]+"
BUCKET = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sources_of(sized: DataFrame, shelf: Shelf, weights: tuple[float, ...]) -> DataFrame:
    """(source, size, n, least, weight) for each source: words, documents, words of the smallest document that has any, weight by rank."""
    own = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    ranked = shelf.put(own.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)  # the number of a row in its partition is in the lower 33 bits
    held = sorted((r["part"], r["n"]) for r in ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = dict(zip((p for p, _ in held), np.cumsum([0, *(n for _, n in held)]).tolist()))
    base = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), part) if before else F.lit(0)
    rank = base + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    return ranked.withColumn("weight", weight).drop("at")


def with_targets(sources: DataFrame, shelf: Shelf, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` with their target: ``share`` of all sizes by weight, none above ``most`` times its own size.

    The words a unit of weight gets rise until no source is above; each step is a sum.
    """
    sources = shelf.put(sources, "sources")
    total, weight = sources.agg(F.sum("size"), F.sum("weight")).first()
    unit, full = (share * total / weight if weight else 0.0), most * F.col("size")
    while weight:
        closed = F.lit(unit) * F.col("weight") > full
        taken, left = sources.agg(F.sum(F.when(closed, full).otherwise(0.0)), F.sum(F.when(closed, 0.0).otherwise(F.col("weight")))).first()
        above = (share * total - taken) / left if left else unit
        if above <= unit * (1 + 1e-12):
            break
        unit = above
    return sources.withColumn("target", F.least(F.lit(unit) * F.col("weight"), full))


def solved(sized: DataFrame, sources: DataFrame, shelf: Shelf, most: float, rounds: int, tolerance: float) -> DataFrame:
    """``sources`` with the dual of each, after at most ``rounds`` steps."""
    sizes = shelf.put(sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "histogram").withColumnRenamed("source", "of")
    open_ = (F.col("target") > 0) & (F.col("target") < most * F.col("size"))
    span = F.log(F.when(F.col("target") > F.col("size"), F.lit(most)).otherwise(F.col("target") / F.col("size"))) / F.col("least")
    state = sources.withColumn("open", open_).withColumn("dual", F.lit(0.0)).withColumn("low", F.least(span, F.lit(0.0))).withColumn("high", F.greatest(span, F.lit(0.0)))
    for turn in range(rounds):
        wide = sizes.withColumnRenamed("size", "words").join(state.where("open").select("source", "dual"), F.col("of").eqNullSafe(F.col("source"))).drop("source")
        words, rate = F.col("words") * F.col("docs"), F.least(F.lit(float(most)), F.exp(F.col("dual") * F.col("words")))
        sums = wide.groupBy("of").agg(F.sum(words * rate).alias("total"), F.sum(F.when(rate < most, words * F.col("words") * rate).otherwise(0.0)).alias("bend"))
        found = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        gap = F.col("total") - F.col("target")
        found = found.withColumn("high", F.when(gap > 0, F.col("dual")).otherwise(F.col("high"))).withColumn("low", F.when(gap < 0, F.col("dual")).otherwise(F.col("low")))
        newton, middle = F.col("dual") - gap / F.col("bend"), (F.col("low") + F.col("high")) / 2
        inside = (F.col("bend") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        moved = F.when(F.col("total").isNull() | (gap == 0), F.col("dual")).when(inside, newton).otherwise(middle)
        found = found.withColumn("off", F.abs(gap) / F.col("target")).withColumn("dual", F.when(F.col("off") > tolerance, moved).otherwise(F.col("dual")))
        state = shelf.put(found.drop("total", "bend"), f"duals-{turn}")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
        state = state.drop("off")
    return state.drop("off")


def _spread(group: pa.Table) -> pa.Table:
    """Round the rates of a bucket, largest documents first, carrying the error in words."""
    size, rate = (group[c].to_numpy().astype(np.float64) for c in ("size", "rate"))
    copies, carried = np.floor(rate), 0.0
    for i in np.lexsort((group["order"].to_numpy(), -size)):
        part = (rate[i] - copies[i]) * size[i]
        carried += part
        if part > 0 and carried >= size[i] / 2:
            copies[i] += 1
            carried -= size[i]
    copies[size == 0] = 0
    return group.select(["id", "source", "text_hash", "size", "source_size", "target", "rate"]).append_column("copies", pa.array(copies.astype(np.int64)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(id, source, text_hash, size, source_size, target, rate, copies) for every row of ``docs``."""
    shelf = Shelf(docs.sparkSession, "mixing")
    named = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sized = shelf.put(named.select("id", "source", F.xxhash64("text").alias("text_hash"), size_of(F.col("text")).alias("size")), "sizes")
    sources = shelf.put(solved(sized, with_targets(sources_of(sized, shelf, weights), shelf, share, most), shelf, most, rounds, tolerance), "solved")
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("open"), F.least(F.lit(float(most)), F.exp(F.col("dual") * F.col("size")))).otherwise(float(most))
    held = sources.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "n", "target", "open", "dual")
    rated = sized.join(held, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate).withColumn("order", F.xxhash64("id", "text_hash"))
    rated = rated.withColumn("bucket", F.pmod("order", F.ceil(F.col("n") / BUCKET).cast("long"))).drop("of", "n", "open", "dual")
    id_type, of_type = (sized.schema[c].dataType.simpleString() for c in ("id", "source"))
    kinds = f"id {id_type}, source {of_type}, text_hash long, size long, source_size long, target double, rate double, copies long"
    return rated.groupBy("source", "bucket").applyInArrow(_spread, kinds).withColumnRenamed("id", id_col)


def repeat(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as ``mixed`` has copies of it; equal rows share theirs."""
    names = {}
    for wanted in ("id_of", "source_of", "hash_of", "text_hash", "copies", "rows", "nth", "copy"):
        names[wanted] = free_name(docs, wanted)
    hashed, nth, copies, rows = (F.col(names[x]) for x in ("text_hash", "nth", "copies", "rows"))
    held = mixed.groupBy(F.col(id_col).alias(names["id_of"]), F.col("source").alias(names["source_of"]), F.col("text_hash").alias(names["hash_of"]))
    held = held.agg(F.sum("copies").alias(names["copies"]), F.count(F.lit(1)).alias(names["rows"])).where(copies > 0)
    joined = docs.withColumn(names["text_hash"], F.xxhash64(text_col)).join(
        held, F.col(id_col).eqNullSafe(F.col(names["id_of"])) & F.col(source_col).eqNullSafe(F.col(names["source_of"])) & (hashed == F.col(names["hash_of"]))
    )
    found = joined.withColumn(names["nth"], F.lit(1))
    if not mixed.groupBy(id_col, "source", "text_hash").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        same = Window.partitionBy(names["id_of"], names["source_of"], names["hash_of"]).orderBy(names["hash_of"])
        found = found.where(rows == 1).unionByName(joined.where(rows > 1).withColumn(names["nth"], F.row_number().over(same)))
    own = F.floor(copies / rows) + (nth <= copies % rows).cast("long")
    found = found.withColumn(names["copy"], own).where(F.col(names["copy"]) > 0)
    return found.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copy"]).cast("int")))).select(*docs.columns)
