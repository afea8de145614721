"""Queries over streams of events: estimates after every batch, families that need whole batches, windows by event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.operators import cardinality, sketches
from setforge.plans.catalog import GHLL2, SET2, _rounded, query, registers_sql, simple_sql, table
from setforge.sources.stored import new_folder
from setforge.streaming import sketch_stream

PARTS = 3
#: How long windows wait for late events.
LATE = "1 hour"


def arriving(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """The events as a stream of ``PARTS`` files that came one after another, read one a batch."""
    events = table(spark, sf, "events")
    for part in range(PARTS):
        events.where(F.col("event_id") % PARTS == part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


_SO_FAR = f"SELECT b || '~' || event_type AS key, user_id AS x FROM events, range({PARTS}) t(b) WHERE event_id % {PARTS} <= b"


@query("stream_estimates", f"SELECT split_part(key, '~', 1)::INT AS batch, split_part(key, '~', 2) AS key, round(estimate, 4) AS estimate FROM ({simple_sql(registers_sql(_SO_FAR, GHLL2), GHLL2)})")
def stream_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users by type of event after every batch."""
    folder = new_folder(spark, "stream-estimates")
    elements = arriving(spark, sf, f"{folder}/in").select(F.col("event_type").alias("key"), F.col("user_id").alias("x"))
    sketch_stream.running_estimates(GHLL2, elements, "x", ["key"], cardinality.simple, folder, f"{folder}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{folder}/estimates")
    return _rounded(found, 4, ("batch", "key"))


@query("stream_setsketch2_registers", registers_sql("SELECT event_type AS key, user_id AS x FROM events", SET2))
def stream_setsketch2_registers(spark: SparkSession, sf: str) -> DataFrame:
    """A family that ranks an element's registers: a sketch a batch, merged when read."""
    folder = new_folder(spark, "stream-batches")
    elements = arriving(spark, sf, f"{folder}/in").select(F.col("event_type").alias("key"), F.col("user_id").alias("x"))
    sketch_stream.running_batches(SET2, elements, "x", ["key"], f"{folder}/sketches", f"{folder}/checkpoint").awaitTermination()
    return sketches.merge(SET2, spark.read.parquet(f"{folder}/sketches"), ["key"])


_DAYS = "SELECT event_type || '~' || strftime(date_trunc('day', ts), '%Y-%m-%d') AS key, user_id AS x FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("stream_windows", f"SELECT split_part(key, '~', 1) AS key, split_part(key, '~', 2) AS day, round(estimate, 4) AS estimate FROM ({simple_sql(registers_sql(_DAYS, GHLL2), GHLL2)})")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users by type and day of the event, for the days that no event within the allowed delay can still change."""
    folder = new_folder(spark, "stream-windows")
    events = table(spark, sf, "events")
    events.write.parquet(f"{folder}/in")
    elements = spark.readStream.schema(events.schema).parquet(f"{folder}/in").select(F.col("event_type").alias("key"), F.col("user_id").alias("x"), F.col("ts").cast("timestamp").alias("ts"))
    registers = sketch_stream.running(GHLL2, elements, "x", ["key"], window="1 day", time="ts", late=LATE)
    flat = registers.select("key", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "reg", "k")
    name = f"windows_{uuid.uuid4().hex}"
    flat.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema("key string, day string, reg int, k int").parquet(f"{folder}/{name}")
    return _rounded(cardinality.simple(GHLL2, closed, ["key", "day"]), 4, ("key", "day"))
