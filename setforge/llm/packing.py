"""Packing by concatenating and cutting.

All documents' tokens (each followed by an end token) form one stream, cut every
``length`` tokens.  Two passes of prefix sums give every document its place: the
first pass tokenizes, numbers tokens inside each partition and stores them with
the partition's number; the partitions' totals, one row a partition, become base
offsets; the second pass adds the two and cuts at multiples of ``length``.  A
document across a cut gives a boundary record on each side.  Only the last
sequence needs padding.

Scale: no shuffle of documents at all; the partition totals are the only
aggregate.  The stored table holds token ids as the partition's task committed
them, so lost executors are repaired from it or by running the task again.

Defined cases: null text is empty text (only its end token); equal rows, equal
ids included, are packed each on its own; an empty table gives an empty result;
a document longer than a sequence is spread over several; other columns are
neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.shared import Shelf, as_texts, freeing

LENGTH = 2048
END = 1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabularies of byte-level BPE: itself if it shows, else the next above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}


class Encoder:
    """Ids of a byte-level BPE tokenizer as it stands; none are added.

    Where the vocabulary numbers its merges in their order, a faster library gives
    the same ids from the same file.  It is used for texts of Latin letters and
    common punctuation, on whose classes all Unicode versions agree; other texts,
    and those with a special token's string, go to the tokenizer itself.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        letters, special = byte_letters(), {t["content"] for t in held["added_tokens"]}
        strings = [regex.escape(x) for x in special]
        self.other = regex.compile("|".join(["[^\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u203a]", *strings])).search
        ranks = {bytes(letters[c] for c in word): i for word, i in held["model"]["vocab"].items() if word not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        ordered = all(held["model"]["vocab"].get(x + y) == 256 + k for k, (x, y) in enumerate(merges))
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not self.other(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """(id, part, before, n, ids): ids little-endian, 16 bits where the vocabulary fits, else 32."""
    import public_tokenizers

    pattern = public_tokenizers.PATTERN
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, encode = TaskContext.get().partitionId(), 0, encoder(path, pattern).encode
        end = np.array([END], np.uint32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                found = [np.concatenate([encode(t), end]) for t in as_texts(piece.column(1))]
                ns = np.array([len(x) for x in found], np.int64)
                starts = before + np.cumsum(ns) - ns
                before += int(ns.sum())
                small = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"" for x in found]
                large = [b"" if s else x.astype("<u4").tobytes() for s, x in zip(small, found)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(len(ns), part, np.int64)), pa.array(starts), pa.array(ns), pa.array(small, pa.binary()), pa.array(large, pa.binary())],
                    names=[id_col, "part", "before", "n", "ids16", "ids32"],
                )

    return docs.select(id_col, text_col).mapInArrow(freeing(run), f"`{id_col}` {id_type}, part bigint, before bigint, n bigint, ids16 binary, ids32 binary")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) for every piece."""
    spark = docs.sparkSession
    tokens = Shelf(spark, "packing").put(tokenized(docs, tokenizer_path, id_col, text_col), "tokens")
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n
    sent = spark.sparkContext.broadcast(base)
    id_type = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = sent.value
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0)
            of: list[int] = []
            for i, (part, before, n, small, large) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)))):
                stream = np.frombuffer(small, "<u2").astype("<u4") if small else np.frombuffer(large, "<u4")
                first = base[part] + before
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    size = min(n - start, length - offset)
                    piece = stream[start : start + size].tobytes()
                    rows.append((start, size, zlib.crc32(piece), n, sequence, offset, piece))
                    of.append(i)
                    start += size
            if not rows:
                continue
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *arrays], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return tokens.mapInArrow(freeing(run), f"`{id_col}` {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
