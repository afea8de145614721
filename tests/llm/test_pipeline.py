"""The corpus pipeline, stage by stage and whole, against plain Python."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from setforge.llm import pii, quality_rules
from tests_llm_words import prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(77)
    out = []
    for i in range(240):
        text = prose(rng, 80)
        if i % 12 == 1:
            text = out[-1][1]  # an exact copy
        elif i % 12 == 2:
            text = out[-1][1] + " tail"  # a near copy of the two before
        elif i % 12 == 3:
            text = "too short"
        elif i % 12 == 4:
            text = "again and again the very same words " * 12
        elif i % 12 == 5:
            text += " write to someone@example.org or call +41 44 123 45 67"
        out.append((i, text, "en", ["a", "b", None][i % 3], len(text)))
    out += [(None, None, None, None, None), (300, "", "en", "a", 0), (301, None, "en", "b", 0), (None, prose(rng, 50), "en", "a", 1), (7, prose(rng, 50), "en", "a", 1)]
    return out


def brute(rows):
    """What the first four stages leave, as far as plain Python can say: rows before mixing."""
    kept = []
    for r in rows:
        words = (r[1] or "").split()
        repeats = quality_rules.repeated_words([w.encode() for w in words])
        if len(words) >= 20 and 100 * repeats <= 30 * len(words):
            kept.append(r)
    sets = [{tuple(r[1].lower().split()[j : j + 5]) for j in range(len(r[1].split()) - 4)} for r in kept]
    parent = list(range(len(kept)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(kept)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    kept = [r for k, r in enumerate(kept) if root(k) == k]
    return [(r[0], pii.redacted(r[1]), r[2], r[3], len(pii.redacted(r[1]))) for r in kept]


def test_stages_equal_brute_force(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for name in ("quality rules", "near-duplicates", "personal data"):
        docs = STAGES[name](spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    want = brute(rows)
    assert sorted(map(repr, map(tuple, docs.collect()))) == sorted(map(repr, want))
    assert any("<EMAIL>" in r[1] and "<PHONE>" in r[1] for r in want) and len(want) < 200
    mixed = STAGES["mixing"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    taken = collections.Counter(map(tuple, mixed.collect()))
    assert set(taken) <= set(want) and max(taken.values()) <= 2
    total, by_source = sum(len(r[1].split()) for r in want), collections.Counter()
    for r, n in taken.items():
        by_source[r[3]] += n * len(r[1].split())
    assert abs(sum(by_source.values()) - 1.5 * total) < 400
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = collections.Counter()
    for r in STAGES["packing"](spark, docs, str(tmp_path)).collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        ids.update(np.frombuffer(r["ids"], "<u4").tolist())
    every = collections.Counter(x for r in want for x in [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1])
    assert ids == every


def test_whole_run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    in_order = sorted((r["sequence_id"], r["offset"], r["length"]) for r in found)
    at = 0
    for sequence, offset, length in in_order:
        assert 2048 * sequence + offset == at
        at += length


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_empty_tables(spark, name, tmp_path):
    assert STAGES[name](spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_stages_carry_clashing_columns(spark, rows, name, tmp_path):
    extra = ["kept", "row", "copies", "nth", "host", "size", "component_id", "hash_of", "text_hash", "n_words", "base_failed", "label"]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(k).alias(x) for k, x in enumerate(extra)))
    found = STAGES[name](spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    assert all([r[x] for x in extra] == list(range(len(extra))) for r in found.collect())
