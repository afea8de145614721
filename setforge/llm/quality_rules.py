"""Host-level quality rules.

Each document gets measures and, from these, fails some of four rules: few words,
repeated windows, symbols, repeated lines; the first two decide the base verdict.
Failures of each rule are counted by host, a host's rate is shrunk towards an
empirical beta prior fitted to that rule over all hosts by moments, and a host is
rejected as a whole if for some rule its rate, by the posterior, exceeds
``max_rate`` by two standard deviations.  So a small host is judged by what hosts
are usually like, and one is kept that most of its documents speak for.

Scale: one pass of Arrow batches measures the texts and is stored, with the texts
only where asked for; the only shuffle is a partially aggregated count by host, so
a host with a third of all rows costs one row a task.  The host table is written
first, so that its size is known when the planner chooses between broadcasting it
and a sorted join, whose large partitions Spark splits.

Defined cases: null text is empty text (no words, so it fails); a null host is a
host of its own; equal rows are judged alike and all kept; an empty table gives
an empty result; other columns of the input are carried along, and new columns
avoid their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from setforge.llm.shared import Shelf, as_bytes, free_name, map_batches

SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_POWERS = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight that occur at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = sum(hashed[j : j + n] * _POWERS[j] for j in range(WINDOW))
    if np.unique(windows).size == n:  # equal windows always have equal hashes
        return 0
    seen: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 1, np.int64)
    for i in range(n):
        key = tuple(words[i : i + WINDOW])
        first = seen.setdefault(key, i)
        if first != i:
            for at in (i, first):
                covered[at] += 1
                covered[at + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """The values of ``MEASURES`` for one text."""
    words = text.split()
    blanks = len(text) - sum(map(len, words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.decode("utf-8", "replace")) - blanks,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def with_measures(docs: DataFrame, text_col: str = "text", with_text: bool = True) -> tuple[DataFrame, list[str]]:
    """``docs``, its text only ``with_text``, with a column for each measure, and the names these have."""
    names = [free_name(docs, m) for m in MEASURES]
    at = docs.columns.index(text_col)
    held = [k for k in range(len(docs.columns)) if with_text or k != at]
    fields = StructType([docs.schema.fields[k] for k in held])
    for name in names:
        fields = fields.add(name, "long")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [measures(t) for t in as_bytes(batch.column(at))]
            new = [pa.array(col, pa.int64()) for col in zip(*found)]
            return pa.RecordBatch.from_arrays([*(batch.columns[k] for k in held), *new], names=[*(batch.schema.names[k] for k in held), *names])

        return one

    return map_batches(docs, make, fields), names


def failures(at: dict[str, str], min_words: int, max_repeat_percent: int) -> dict[str, Column]:
    """Whether a document fails each rule; the first two make up the base verdict."""
    words, chars, symbols, lines, repeats = (F.col(at[m]) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return {
        "few_words": words < min_words,
        "repeats": 100 * repeats > max_repeat_percent * words,
        "symbols": 10 * symbols > chars,
        "lines": 10 * lines > words,
    }


def host_verdicts(failed: DataFrame, rules: list[str], shelf: Shelf, max_rate: float) -> DataFrame:
    """From rows (host, a boolean for each rule): host, n, host_rate (the highest of the shrunk rates), host_bad.

    The priors are one row for all hosts, so they reach the driver as two numbers a rule.
    """
    hosts = failed.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in rules))
    hosts = shelf.put(hosts, "hosts")
    moments = hosts.agg(*(f(F.col(r) / F.col("n")) for r in rules for f in (F.avg, F.var_pop))).first()
    rates, over = [], F.lit(False)
    for k, r in enumerate(rules):
        mean, variance = moments[2 * k] or 0.0, moments[2 * k + 1] or 0.0
        strength = min(1000.0, max(1.0, mean * (1 - mean) / variance - 1)) if variance > 0 else 1000.0
        rate = (F.col(r) + mean * strength) / (F.col("n") + strength)
        rates.append(rate)
        over |= rate - 2 * F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1)) > max_rate
    return hosts.select("host", "n", F.greatest(*rates).alias("host_rate"), over.alias("host_bad"))


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = 20, max_repeat_percent: int = 30, max_rate: float = 0.25, with_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """All rows and columns of ``docs`` (the text only ``with_text``) with measures, base_failed, host_rate and kept.

    The second result maps each of these to the column that holds it.
    """
    shelf = Shelf(docs.sparkSession, "quality")
    measured, names = with_measures(docs, text_col, with_text)
    measured = shelf.put(measured, "measured")
    at = dict(zip(MEASURES, names))
    failed = failures(at, min_words, max_repeat_percent)
    hosts = host_verdicts(measured.select(F.col(host_col).alias("host"), *(c.alias(r) for r, c in failed.items())), list(failed), shelf, max_rate)
    at["base_failed"] = free_name(measured, "base_failed")
    rows = measured.withColumn(at["base_failed"], failed["few_words"] | failed["repeats"])
    at["host_rate"], at["kept"] = free_name(rows, "host_rate"), free_name(rows, "kept")
    host, bad = free_name(rows, "host"), free_name(rows, "host_bad")
    verdicts = hosts.select(F.col("host").alias(host), F.col("host_rate").alias(at["host_rate"]), F.col("host_bad").alias(bad))
    joined = rows.join(verdicts, rows[host_col].eqNullSafe(verdicts[host]), "left")
    return joined.withColumn(at["kept"], ~F.col(at["base_failed"]) & ~F.coalesce(bad, F.lit(False))).drop(host, bad), at
