"""Sketches over streams.

Inserting is idempotent and commutative, so a running sketch is a stateful
maximum by key and register; replays and late rows change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from setforge.config import MinHash, SetSketch1, SetSketch2, SketchFamily
from setforge.functions.hashing import bits
from setforge.operators.families import best, empty
from setforge.operators.points import register_value, setsketch1_points, updates
from setforge.operators.sketches import build, merge
from setforge.sources.stored import delete


def running(cfg: SketchFamily, stream: DataFrame, element: str, keys: list[str], window: str | None = None, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The streaming DataFrame (keys..., reg, k), optionally by event-time window."""
    if isinstance(cfg, SetSketch2):
        raise ValueError("SetSketch2 ranks registers by element, which streams cannot; use running_batches")
    if window and time:
        stream = stream.withWatermark(time, late).withColumn("window", F.window(time, window))
        keys = [*keys, "window"]
    distinct_free = _updates_without_distinct(cfg, stream, element, keys)
    found = distinct_free.groupBy(*keys, "reg").agg(best(cfg))
    return found.where(F.col("k") != empty(cfg))


def _updates_without_distinct(cfg: SketchFamily, stream: DataFrame, element: str, keys: list[str]) -> DataFrame:
    """Batch updates drop repeated elements first; in a stream the aggregate does."""

    rows = stream.where(F.col(element).isNotNull()).select(*keys, element)
    if isinstance(cfg, MinHash):
        every = rows.withColumn("reg", F.explode(F.sequence(F.lit(0), F.lit(cfg.m - 1))))
        return every.select(*keys, "reg", bits(cfg.scheme, F.col(element), F.col("reg"), 1, 15).alias("k"))
    if isinstance(cfg, SetSketch1):
        return setsketch1_points(cfg, rows, element).select(*keys, "reg", register_value(F.col("x"), cfg.b, cfg.q).alias("k"))
    return updates(cfg, rows, element, keys)


def to_memory(cfg: SketchFamily, stream: DataFrame, element: str, keys: list[str], name: str, checkpoint: str) -> StreamingQuery:
    """A running sketch in a memory table, brought up to date with what is available."""
    return running(cfg, stream, element, keys).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_batches(cfg: SketchFamily, stream: DataFrame, element: str, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """For any family: each micro-batch's sketch goes to its own folder by batch number, so a replay overwrites itself."""

    def one(batch: DataFrame, number: int) -> None:
        build(cfg, batch, element, keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def take_batch(cfg: SketchFamily, batch: DataFrame, number: int, element: str, keys: list[str], estimate: Callable[..., DataFrame], path: str) -> None:
    """Merge a batch into the state that the batch before it left; state and estimates go to folders under the batch's number.

    Nothing that is read is changed, so a batch that is taken again writes the same
    once more; states older than the one before are deleted.
    """
    spark, state = batch.sparkSession, f"{path}/state"
    sketch = build(cfg, batch, element, keys)
    if number:
        sketch = merge(cfg, spark.read.parquet(f"{state}/batch={number - 1}").unionByName(sketch), keys)
    sketch.write.mode("overwrite").parquet(f"{state}/batch={number}")
    estimate(cfg, spark.read.parquet(f"{state}/batch={number}"), keys).write.mode("overwrite").parquet(f"{path}/estimates/batch={number}")
    if number > 1:
        delete(spark, f"{state}/batch={number - 2}")


def running_estimates(cfg: SketchFamily, stream: DataFrame, element: str, keys: list[str], estimate: Callable[..., DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """For any family: (batch, keys..., estimate) in ``path``/estimates after every micro-batch, over all elements so far."""

    def one(batch: DataFrame, number: int) -> None:
        take_batch(cfg, batch, number, element, keys, estimate, path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
