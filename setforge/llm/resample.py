"""Resampling towards a target distribution by importance weights.

Features are runs of 1 to ``longest`` words, hashed into buckets.  Two counting
passes give every bucket's share among the documents and in the target texts; the
logarithm of their ratio, in thousandths, is the bucket's gain.  A document's
weight is the sum of its features' gains, looked up in one array, and its score
adds Gumbel noise drawn from its id: the highest scores are a sample without
replacement in proportion to exp(weight / 1000).

Scores are whole numbers, so an exact histogram by score finds the cutoff: its
counts, summed from the highest score down, say how many documents lie above each
score.  Documents at or above the cutoff get their rank from that offset and a
``row_number`` by id among those of one score.

Scale: bucket counts leave a task as one row a bucket, and only the bounded table
of gains goes to the driver and to all tasks.  Texts are read twice and never
shuffled.  The histogram and the surviving rows are range-partitioned; totals, one
row a partition, carry the sums from one partition to the next.  Rows of one score
and id are told apart by a row number, so that a range may end between them and
repeated rows, however many, fill no single task.

Defined cases: null text has no features, weight 0; a null id counts as empty text
for the noise and ranks last in ties; equal rows are ranked each on its own, next
to each other and in no defined order; empty documents give an empty result; with
an empty target every gain follows from T = 0; long texts are read whole, a piece
at a time; other columns of the input are carried along, and new columns avoid
their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from setforge.llm.shared import Shelf, as_bytes, free_name, freeing, plain_words

BUCKETS = 10_000
#: Words a task remembers, and the longest of them.
REMEMBERED, REMEMBERED_BYTES = 1 << 18, 64


class Remembered(dict):
    """What ``of`` says about a feature, kept for as many short features as are allowed."""

    def __init__(self, of: Callable[[bytes], int]):
        self.of = of

    def __missing__(self, feature: bytes) -> int:
        value = self.of(feature)
        if len(feature) <= REMEMBERED_BYTES and len(self) < REMEMBERED:
            self[feature] = value
        return value


def features(text: bytes, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """For each piece of a text: its number of words and the features that end in it."""
    before: list[bytes] = []
    for words in plain_words(text):
        found = list(words)
        if longest > 1:
            row = before + words
            for size in range(2, longest + 1):
                first = max(0, len(before) - size + 1)
                found += [b" ".join(row[i : i + size]) for i in range(first, len(row) - size + 1)]
            before = row[-(longest - 1) :]
        yield len(words), found


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, counts = Remembered(lambda feature: zlib.crc32(feature) % buckets).__getitem__, np.zeros(buckets, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                for _, found in features(text, longest):
                    np.add.at(counts, np.fromiter(map(bucket, found), np.int64, len(found)), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    counted = texts.select(text_col).mapInArrow(freeing(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # one row a bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Thousandths of the log ratio of the two smoothed shares of each bucket."""
    buckets = len(source)
    all_source, all_target = float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((float(t) + 1) * (all_source + buckets) / ((float(s) + 1) * (all_target + buckets)))) for s, t in zip(source, target)]


def noise(doc_id, seed: str) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], id_col: str, text_col: str, longest: int, seed: str, names: list[str], with_text: bool) -> DataFrame:
    """``docs`` with the number of words, of features, the weight and the score, under ``names``."""
    at, of = docs.columns.index(text_col), docs.columns.index(id_col)
    held = [k for k in range(len(docs.columns)) if with_text or k != at]
    schema = StructType([docs.schema.fields[k] for k in held])
    for name in names:
        schema = schema.add(name, "long")
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        gain_of = Remembered(lambda feature: table[zlib.crc32(feature) % buckets]).__getitem__
        for batch in batches:
            rows = []
            for text, doc_id in zip(as_bytes(batch.column(at)), batch.column(of).to_pylist()):
                n_words = n_features = weight = 0
                for words, found in features(text, longest):
                    n_words, n_features, weight = n_words + words, n_features + len(found), weight + sum(map(gain_of, found))
                rows.append((n_words, n_features, weight, weight + noise(doc_id, seed)))
            if rows:
                new = [pa.array(column, pa.int64()) for column in zip(*rows)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in held), *new], names=[*(batch.schema.names[k] for k in held), *names])

    return docs.mapInArrow(freeing(run), schema)


def carried(totals: DataFrame, part: str, n: str) -> tuple[list[tuple[int, int]], int]:
    """(part, sum of all parts before it) and the sum of all; one row a partition reaches the driver."""
    out, before = [], 0
    for row in sorted(totals.collect(), key=lambda r: r[part]):
        out.append((row[part], before))
        before += row[n]
    return out, before


def ranks(rows: DataFrame, id_col: str, score: str, rank: str, eligible: str, percent: int, shelf: Shelf) -> DataFrame:
    """``rows``, a stored table, with the rank of those drawn: ``percent`` of the eligible ones, by score, ties to the smaller id."""
    spark = rows.sparkSession
    part, n, above, row = (free_name(rows, name) for name in ("__part", "__n", "__above", "__row"))
    # the histogram, highest score first, and how many rows lie above each score
    counts = rows.where(eligible).groupBy(score).agg(F.count(F.lit(1)).alias(n))
    counts = shelf.put(counts.repartitionByRange(F.desc(score)).withColumn(part, F.spark_partition_id()), "histogram")
    bases, total = carried(counts.groupBy(part).agg(F.sum(n).alias(n)), part, n)
    draws = percent * total // 100
    if draws == 0:
        return rows.withColumn(rank, F.lit(None).cast("long"))
    last = max(p for p, before in bases if before < draws)
    down = Window.partitionBy(part).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    base = spark.createDataFrame(pa.table({part: pa.array([p for p, _ in bases], pa.int32()), above: pa.array([x for _, x in bases], pa.int64())}))
    offsets = counts.where(F.col(part) <= last).join(F.broadcast(base), part)  # one row a partition
    offsets = offsets.select(score, (F.col(above) + F.coalesce(F.sum(n).over(down), F.lit(0))).alias(above)).where(F.col(above) < draws)
    offsets = shelf.put(offsets, "offsets")
    cutoff = offsets.agg(F.min(score)).first()[0]
    # number the survivors of each score by id, in parts that may end inside a score
    survives = F.col(eligible) & (F.col(score) >= cutoff)
    order = [F.col(id_col).asc_nulls_last(), F.col(row)]
    kept = shelf.put(rows.where(survives).withColumn(row, F.monotonically_increasing_id()), "survivors")
    kept = shelf.put(kept.repartitionByRange(F.desc(score), *order).withColumn(part, F.spark_partition_id()), "ranges")
    held = kept.groupBy(score, part).agg(F.count(F.lit(1)).alias(n)).join(offsets, score)
    earlier = Window.partitionBy(score).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(score, part, (F.col(above) + F.coalesce(F.sum(n).over(earlier), F.lit(0))).alias(above))
    numbered = kept.join(held, [score, part]).withColumn(rank, F.col(above) + F.row_number().over(Window.partitionBy(score, part).orderBy(*order)))
    drawn = numbered.select(*rows.columns, F.when(F.col(rank) <= draws, F.col(rank)).alias(rank))
    return rows.where(~survives).withColumn(rank, F.lit(None).cast("long")).unionByName(drawn)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 1, buckets: int = BUCKETS, min_words: int = 20, percent: int = 10, seed: str = "2024", with_text: bool = True
) -> tuple[DataFrame, dict[str, str]]:
    """All rows and columns of ``docs`` (the text only ``with_text``) with n_words, n_features, weight, score and rank.

    Drawn are ``percent`` of the rows with at least ``min_words`` words; others have
    no rank.  The second result maps each of these to the column that holds it.
    """
    shelf = Shelf(docs.sparkSession, "resample")
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets))
    at = {name: free_name(docs, name) for name in ("n_words", "n_features", "weight", "score", "rank")}
    measured = shelf.put(scored(docs, gain, id_col, text_col, longest, seed, [at[k] for k in ("n_words", "n_features", "weight", "score")], with_text), "scored")
    eligible = free_name(measured, "__eligible")
    rows = measured.withColumn(eligible, F.col(at["n_words"]) >= min_words)
    return ranks(rows, id_col, at["score"], at["rank"], eligible, percent, shelf).drop(eligible), at
