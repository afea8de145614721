"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet
and read again as the next one's documents.  All stages but the last return the
columns of documents; the last returns pieces of packed sequences.

Defined cases, for every stage: an empty table gives an empty result; columns beyond
those of documents are carried along (not by packing), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.llm.mixing import mix, repeat
from setforge.llm.near_dedup import near_duplicates
from setforge.llm.packing import pack
from setforge.llm.pii import redact
from setforge.llm.quality_rules import quality_rules
from setforge.llm.shared import Shelf, free_name, freed_shelves, modest_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules for themselves and their host; null text has no words and goes, a null source is a host."""
    modest_batches(spark)
    judged, at = quality_rules(docs)
    return judged.where(F.col(at["kept"])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 80 %: the first row.

    Rows are numbered, so null and repeated ids are documents like others; rows of
    equal text are one group, and those without words stay.
    """
    modest_batches(spark)
    shelf, row = Shelf(spark, "pipeline"), free_name(docs, "row")
    numbered = shelf.put(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    gone = near_duplicates(numbered, id_col=row, width=5, percent=80).where(~F.col("kept")).select(row)
    # the rejected rows are written first, so that the planner knows their size
    return numbered.join(shelf.put(gone, "gone"), row, "left_anti").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and their new length; null text stays null."""
    modest_batches(spark)
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are never taken."""
    modest_batches(spark)
    return repeat(docs, mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; null text is one end token."""
    modest_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("personal data", pii),
    ("mixing", mixing),
    ("packing", packing),
]

#: No SQL: several stages are beyond it; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; only the last one's table stays in the shared folder."""
    shelf = Shelf(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with freed_shelves():
            docs = shelf.put(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            shelf.drop(f"stage-{k - 1}")
    return docs
