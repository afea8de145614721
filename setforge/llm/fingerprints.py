"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into dictionary phrases (each the longest phrase
seen so far plus one byte).  The set of phrase hashes is sketched by ``SLOTS``
minimum hashes; the share of equal slots estimates the Jaccard similarity of two
phrase sets, which behaves like a compression distance.

``fingerprint_with_next`` also fingerprints an edited text, for which each
document needs its successor in descending id order.  Rows are dealt to ranges
of ids, one a partition; the first document of a range is sent to the range
before as well, so that every task holds all successors it needs.  Texts are
shuffled once and no task sees more than its range.  Ranges grow in number with
the text, not in size; their bounds and largest ids are all that the driver holds.

Defined cases: null text is empty text, whose phrase set is empty and whose
fingerprint equals only that of another empty text; equal texts have equal
fingerprints; rows of equal id follow each other in the order of their texts;
a single row is its own successor; an empty table gives an empty result; texts
are parsed whole, in linear time; other columns are neither read nor returned, so
their names cannot clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.shared import as_texts, freeing, map_batches

SLOTS = 64
#: Bytes of text of a range of ids, about, and rows sampled for each range to find its bounds.
RANGE_BYTES, SAMPLE = 128 << 20, 32
#: Stands for a null id, which comes last in descending order.
NO_ID = -(1 << 63)
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(65537)
_MUL = (_rng.integers(0, 1 << 32, SLOTS, np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, SLOTS, np.uint32)[:, None]


class Parse:
    """The state of a phrase parse: a trie of phrases and the hash of each."""

    def __init__(self):
        self.trie: dict[int, int] = {}
        self.node = 0
        self.hashes = [0x9AE16A3B2F90404F]

    def fork(self) -> "Parse":
        other = Parse()
        other.trie, other.node, other.hashes = self.trie.copy(), self.node, self.hashes.copy()
        return other

    def feed(self, data: bytes) -> "Parse":
        trie, node, hashes = self.trie, self.node, self.hashes
        get, count = trie.get, len(hashes)
        for byte in data:
            edge = node << 8 | byte
            node = get(edge)
            if node is None:
                trie[edge] = count
                count += 1
                seed = (hashes[edge >> 8] ^ byte + 1) * 0xFF51AFD7ED558CCD & _MASK
                hashes.append(seed ^ seed >> 33)
                node = 0
        self.node = node
        return self

    def sketch(self) -> np.ndarray:
        """Minimum hashes of the phrases, the unfinished last one included."""
        low = np.array(self.hashes[1:], np.uint64)
        low = ((low ^ (low >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
        out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(low), 4096):
            values = low[k : k + 4096] * _MUL
            values += _ADD
            values ^= values >> np.uint32(16)
            np.minimum(out, values.min(axis=1), out=out)
        return out


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def fingerprint(text: str) -> str:
    return text_of(Parse().feed(text.encode("utf-8", "replace")).sketch())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in as_texts(batch.column(1))], pa.string())], names=[id_col, "fingerprint"])

        return one

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {id_type}, fingerprint string")


def _ranges(rows: DataFrame, range_bytes: int) -> tuple[np.ndarray, dict[int, int]]:
    """Bounds between ranges of about ``range_bytes`` of text, and for each range that has rows its largest id.

    There are at least as many ranges as the session has shuffle partitions, so that small tables use all cores.
    """
    spark = rows.sparkSession
    weighed = rows.select("id", (F.octet_length("text") + 64).alias("weight"))
    whole = weighed.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).first()
    if not whole["n"]:
        return np.zeros(0, np.int64), {}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole["weight"] // range_bytes))
    share = SAMPLE * parts / whole["n"]
    seen = (weighed if share >= 1 else weighed.sample(share, seed=1)).toPandas().sort_values("id")
    ids, reached = seen["id"].to_numpy(np.int64), np.cumsum(seen["weight"].to_numpy(np.float64))
    bounds = np.unique(ids[np.searchsorted(reached, reached[-1] * np.arange(1, parts) / parts)]) if len(ids) else ids
    sent = spark.sparkContext.broadcast(bounds)

    def make():
        bounds = sent.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            held = np.sort(np.asarray(batch.column(0)))
            part = np.searchsorted(bounds, held)
            last = np.append(part[1:] != part[:-1], True)
            return pa.RecordBatch.from_arrays([pa.array(part[last], pa.int32()), pa.array(held[last])], names=["part", "top"])

        return one

    tops = map_batches(rows.select("id"), make, "part int, top bigint").groupBy("part").agg(F.max("top").alias("top"))
    return bounds, {r["part"]: r["top"] for r in tops.toLocalIterator()}


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the one with the next smaller id, after the smallest the
    largest.  The edited text ends in the next document's beginning instead of
    its own last third.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds, tops = _ranges(rows, range_bytes)
    # range k's last document is followed by the largest id of the range below, the lowest range's by the largest of all
    filled = sorted(tops)
    follows = {tops[k]: filled[i + 1] if i + 1 < len(filled) else filled[0] for i, k in enumerate(filled)}
    sent = spark.sparkContext.broadcast((bounds, follows))

    def deal():
        bounds, follows = sent.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, part, guest = [], [], []
            for i, x in enumerate(batch.column(0).to_pylist()):
                at.append(i)
                part.append(bisect_left(bounds, x))
                guest.append(False)
                if x in follows:
                    at.append(i)
                    part.append(follows[x])
                    guest.append(True)
            own = batch.take(pa.array(at))
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(guest), *own.columns], names=["part", "guest", "id", "text"])

        return one

    dealt = map_batches(rows, deal, "part int, guest boolean, id bigint, text string")
    dealt = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "guest", F.desc("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(one: tuple, following: tuple) -> tuple:
            ident, text, head, whole, kept, sketch = one
            other, edited = following[1], None
            tail = other[: len(text) - kept]
            edited = text[:kept] + tail
            changed = head.feed(tail.encode("utf-8", "replace")).sketch()
            return (None if ident == NO_ID else ident, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), text_of(sketch), text_of(changed), likeness(sketch, changed), likeness(sketch, following[5]))

        def opened(ident: int, text: str) -> tuple:
            kept = len(text) - len(text) // 3
            head = Parse().feed(text[:kept].encode("utf-8", "replace"))
            whole = head.fork().feed(text[kept:].encode("utf-8", "replace"))
            return ident, text, head, None, kept, whole.sketch()

        waiting, part, guest_of = None, None, False
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for p, guest, ident, text in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    waiting, part, guest_of = None, p, False
                if guest_of:
                    continue
                one = opened(ident, text)
                if waiting is not None:
                    out.append(finished(waiting, one))
                waiting, guest_of = one, guest
                if len(out) >= 500:
                    yield flushed()
                    out = []
        if out:
            yield flushed()

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return dealt.mapInArrow(freeing(run), f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
