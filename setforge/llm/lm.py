"""Scoring with a hashed maximum-entropy language model.

Items are the commonest words, buckets of all other words by their ending, and the
end of a text.  Items are clustered by what precedes them into ``CLASSES``
classes.  The probability of a token is

    softmax over classes of hashed n-gram and skip features (w-1; w-2; w-3; w-1 w-2)
    x share of the item in its class x share of the word in its bucket,

the last from exact counts over the whole corpus with one place for all unseen
words.  Class weights are trained in ``ROUNDS`` rounds, each over its own part of
the training texts: every task takes AdaGrad steps from the round's weights over
its batches, and the token-weighted mean of their updates is the next weights.
Updates are rounded to a power of two before they are added in double precision,
so that the order of tasks does not change the sum.

Scale: words are counted by a partially aggregated sum.  Texts are then split once
into items, two or four bytes a token, which training and scoring read.  Counts of
the at most ``TOP`` commonest words are broadcast; counts of all others are joined,
word by word, to the documents that hold them.  The model grows with the square
root of the training tokens: words with an item of their own up to ``TOP``, feature
slots up to ``MOST_FEATURES`` (which bounds the broadcast table to 512 MB).  A round
uses so many tasks that their updates take a byte for each training token, and
are summed block by block in the cluster.

Defined cases: null text is empty text, that is one end token; equal rows get
equal scores; without training rows every token is unseen; an empty table gives
an empty result; texts are scored whole; other columns are neither read nor
returned, so their names cannot clash (``training`` may read any).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.llm.shared import Shelf, as_bytes, freeing, map_batches

TOP, BUCKETS, CLASSES, BEFORE = 100_000, 1024, 32, 64
LEAST_VOCABULARY, LEAST_FEATURES, MOST_FEATURES = 1024, 4096, 1 << 22
ROUNDS = 3
RATE = 0.2
#: Cells of a block of a table that is summed in the cluster.
BLOCK = 1 << 12
MEMO = 400_000
#: Logarithms of rare counts are added as whole multiples of its inverse, so that order does not matter.
FIXED = float(1 << 36)
STEP_TOKENS = 1 << 15


def capacity(tokens: int) -> tuple[int, int]:
    """Words with items of their own, and feature slots, for so many training tokens."""
    return min(TOP, max(LEAST_VOCABULARY, isqrt(tokens))), min(MOST_FEATURES, max(LEAST_FEATURES, 2 * isqrt(tokens)))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def bucket_of(word: bytes) -> int:
    """Bucket of a word without an item of its own: by its last three bytes."""
    return xxhash.xxh3_64_intdigest(word[-3:]) % BUCKETS


# ---- sums of fixed tables -------------------------------------------------


def blocks_of(table: np.ndarray) -> pa.RecordBatch:
    """A flat table as rows (block, data); blocks of zeros are left out."""
    flat = table.reshape(-1)
    found = [(k // BLOCK, flat[k : k + BLOCK].tobytes()) for k in range(0, len(flat), BLOCK) if flat[k : k + BLOCK].any()]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], names=["block", "data"])


def summed(rows: DataFrame, shape: tuple[int, ...], dtype: type) -> np.ndarray:
    """The sum of all tables of which ``rows`` hold blocks; floating point is added in double precision."""
    wide = np.float64 if np.issubdtype(dtype, np.floating) else dtype

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("data").to_pylist():
                part = np.frombuffer(data, dtype)
                total = part.astype(wide) if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "data"])

    out = np.zeros(int(np.prod(shape)), wide)
    for r in rows.groupBy("block").applyInArrow(add, "block int, data binary").collect():
        part = np.frombuffer(r["data"], wide)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return out.reshape(shape)


def table_sums(texts: DataFrame, make, shape: tuple[int, ...], dtype: type) -> np.ndarray:
    """``make()`` gives (take a batch, give the table); the tables of all tasks are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, give = make()
        any_rows = False
        for batch in batches:
            if batch.num_rows:
                any_rows = True
                take(batch)
        if any_rows:
            yield blocks_of(give())

    return summed(texts.mapInArrow(freeing(run), "block int, data binary"), shape, dtype)


# ---- items and features ---------------------------------------------------


def item_type(vocabulary: int) -> type:
    return np.uint16 if vocabulary + BUCKETS + 2 <= 1 << 16 else np.uint32


def stream_of(items: list[bytes], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' items with three starts before each text, and where tokens stand."""
    dtype = item_type(vocabulary)
    sizes = np.array([len(x) // np.dtype(dtype).itemsize for x in items], np.int64)
    at = np.arange(sizes.sum()) + 3 * np.repeat(np.arange(1, len(items) + 1), sizes)
    stream = np.full(len(at) + 3 * len(items), vocabulary + BUCKETS + 1, np.int64)
    stream[at] = np.frombuffer(b"".join(items), dtype)
    return stream, at


def features(stream: np.ndarray, at: np.ndarray, slots: int) -> np.ndarray:
    """(4, tokens) hashed features of what precedes each token."""
    one, two, three = stream[at - 1], stream[at - 2], stream[at - 3]
    mixed = np.stack([one * 0x9E3779B1 + 1, two * 0x85EBCA77 + 2, three * 0xC2B2AE3D + 3, one * 0x27D4EB2F + two * 0x165667B1 + 4]) & 0xFFFFFFFF
    mixed ^= mixed >> 15
    mixed = mixed * 0x2C1B3C6D & 0xFFFFFFFF
    return (mixed >> 8) % slots


def class_probabilities(weights: np.ndarray, bias: np.ndarray, feats: np.ndarray) -> np.ndarray:
    logits = weights[feats[0]] + bias
    for f in feats[1:]:
        logits += weights[f]
    np.clip(logits, -80, 80, out=logits)  # far beyond what training reaches; exponents stay finite
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradient(weights: np.ndarray, bias: np.ndarray, feats: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the negative log likelihood of ``classes``: slots with a gradient, its rows there, and that of the bias."""
    gap = class_probabilities(weights, bias, feats)
    gap[np.arange(len(classes)), classes] -= 1
    flat = feats.reshape(-1).astype(np.uint16 if len(weights) <= 1 << 16 else np.uint32)
    order = np.argsort(flat, kind="stable")
    ascending = flat[order]
    new = np.append(True, ascending[1:] != ascending[:-1])
    touched = ascending[new].astype(np.int64)
    place = np.empty(len(flat), np.int64)  # of each feature among those touched
    place[order] = np.cumsum(new) - 1
    place = place.reshape(feats.shape)
    rows = np.empty((len(touched), gap.shape[1]), gap.dtype)
    for c, column in enumerate(np.ascontiguousarray(gap.T).astype(np.float64)):
        rows[:, c] = sum(np.bincount(p, column, len(touched)) for p in place)
    return touched, rows, gap.sum(axis=0)


@dataclass
class Lexicon:
    """What is known of words before training."""

    top: list[bytes]  # the commonest words, by count
    counts: np.ndarray  # their training counts
    total: int  # training tokens
    distinct: int  # distinct training tokens
    ends: int  # training texts
    vocabulary: int  # of the commonest words, how many have an item of their own
    slots: int  # feature slots

    @property
    def end(self) -> int:
        return self.vocabulary + BUCKETS


@dataclass
class Model:
    lexicon: Lexicon
    classes: np.ndarray  # of each item
    token_log: np.ndarray  # log10 of each item's share in its class, less that of what a bucket's counts are divided by
    weights: np.ndarray
    bias: np.ndarray


def clustered(before: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Classes of items by k-means on square roots of the shares of what precedes them; the end, the last item, has its own class."""
    n = before.sum(axis=1)
    rows = np.sqrt(before / np.maximum(n, 1)[:, None])
    k = CLASSES - 1
    order = np.argsort(-n, kind="stable")
    centres = rows[order[np.linspace(0, min(len(order), 2000) - 1, k).astype(int)]]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        for c in range(k):
            if (member := own == c).any() and n[member].sum():
                centres[c] = np.average(rows[member], axis=0, weights=n[member])
    own[-1] = k
    return own


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                found.update(words_of(text))
                if len(found) > MEMO:
                    yield flushed()
                    found.clear()
        if found:
            yield flushed()

    return texts.mapInArrow(freeing(run), "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> list:
    """The ``most`` commonest words, by count, ties in the order of words.

    Counts are taken in steps of an eighth of a power of two, so that a table of
    bounded size finds the limit; of the step that passes it the commonest are taken.
    """
    step = F.floor(F.log2("c") * 8)
    sizes = dict(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())
    held, last, found = 0, None, []
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > most:
            found = counts.where(step == k).orderBy(F.desc("c"), "word").limit(most - held).collect()
            break
        held, last = held + sizes[k], k
    if last is not None:
        found += counts.where(step >= last).collect()
    return sorted(found, key=lambda r: (-r["c"], r["word"]))


def lexicon_of(texts: DataFrame, counts: DataFrame) -> Lexicon:
    """``texts`` has one column, the training texts; ``counts`` their stored word counts."""
    ends = texts.count()
    words, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    ranked = commonest(counts, TOP)
    total = (words or 0) + ends
    vocabulary, slots = capacity(total)
    top = [r["word"].encode() for r in ranked]
    return Lexicon(top, np.array([r["c"] for r in ranked], np.int64), total, distinct + (ends > 0), ends, min(vocabulary, len(top)), slots)


def train(encoded: DataFrame, counts: DataFrame, lexicon: Lexicon) -> Model:
    """``encoded`` has one column, the items of training texts; ``counts`` are all word counts."""
    spark = encoded.sparkSession
    vocabulary, slots, end = lexicon.vocabulary, lexicon.slots, lexicon.end
    sent = spark.sparkContext.broadcast(lexicon.top[:vocabulary])

    def bucket_tables():
        known, table = set(sent.value), np.zeros((BUCKETS, 2), np.int64)

        def take(batch: pa.RecordBatch) -> None:
            for word, c in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                if word not in known:
                    table[bucket_of(word)] += (c, 1)

        return take, lambda: table

    def before_tables():
        table = np.zeros((end + 1) * BEFORE, np.int64)

        def take(batch: pa.RecordBatch) -> None:
            items = batch.column(0).to_pylist()
            for k in range(0, len(items), 200):
                stream, at = stream_of(items[k : k + 200], vocabulary)
                cells, times = np.unique(stream[at] * BEFORE + np.minimum(stream[at - 1], BEFORE - 1), return_counts=True)
                table[cells] += times

        return take, lambda: table

    # so many tasks that their tables take about a byte for each training token
    tasks = max(1, lexicon.total // (4 * CLASSES * slots))
    encoded = encoded.coalesce(tasks)
    of_buckets = table_sums(counts.select("word", "c"), bucket_tables, (BUCKETS, 2), np.int64)
    before = table_sums(encoded, before_tables, (end + 1, BEFORE), np.int64)
    classes = clustered(before)
    n = before.sum(axis=1) + 0.5
    in_class = np.bincount(classes, n, CLASSES)
    weights, bias = np.zeros((slots, CLASSES), np.float32), np.log(np.maximum(in_class, 0.5) / in_class.sum()).astype(np.float32)
    for turn in range(ROUNDS):
        state = spark.sparkContext.broadcast((classes, weights, bias))

        def updates(state=state):
            classes, weights, bias = state.value
            own, own_bias = weights.copy(), bias.copy()
            seen, seen_bias = np.ones_like(own), np.ones_like(own_bias)
            tokens = [0]

            def take(batch: pa.RecordBatch) -> None:
                items = batch.column(0).to_pylist()
                start = size = 0
                for k, one in enumerate(items):
                    size += len(one) // 2
                    if size >= STEP_TOKENS or k + 1 == len(items):
                        step(items[start : k + 1])
                        start, size = k + 1, 0

            def step(items: list[bytes]) -> None:
                stream, at = stream_of(items, vocabulary)
                for k in range(0, len(at), 2 * STEP_TOKENS):
                    part = at[k : k + 2 * STEP_TOKENS]
                    touched, grad, grad_bias = gradient(own, own_bias, features(stream, part, slots), classes[stream[part]])
                    seen[touched] += grad * grad
                    own[touched] -= RATE * grad / np.sqrt(seen[touched])
                    seen_bias[:] += grad_bias * grad_bias
                    own_bias[:] -= 0.1 * RATE * grad_bias / np.sqrt(seen_bias)
                    tokens[0] += len(part)

            def give() -> np.ndarray:
                flat = np.concatenate([(own - weights).reshape(-1), own_bias - bias]).astype(np.float64) * tokens[0]
                grid = 2.0 ** (tokens[0].bit_length() - 17)
                return np.append(np.round(flat / grid) * grid, np.round(tokens[0] / grid) * grid).astype(np.float32)

            return take, give

        part = encoded.where(F.pmod(F.xxhash64(encoded.columns[0]), F.lit(ROUNDS)) == turn)
        total = table_sums(part, updates, (slots * CLASSES + CLASSES + 1,), np.float32)
        if total[-1] > 0:
            weights = (weights + (total[: slots * CLASSES] / total[-1]).reshape(weights.shape)).astype(np.float32)
            bias = (bias + total[slots * CLASSES : -1] / total[-1]).astype(np.float32)
        state.unpersist()
    token_log = np.log10(n / in_class[classes])
    token_log[vocabulary:end] -= np.log10(of_buckets.sum(axis=1) + 1.0)
    return Model(lexicon, classes, token_log, weights, bias)


class _Words(dict):
    """Numbers words as they come and remembers which are new."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Splits texts into items; what depends on counts of rare words is left to a join."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.rank = {w: i for i, w in enumerate(lexicon.top)}
        self.log_counts = np.log10(lexicon.counts + 1.0)
        self.reset()

    def reset(self) -> None:
        self.words, self.spelled = _Words(), []
        self.item, self.log_count, self.rare = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)

    def learn(self) -> None:
        new = self.words.new
        self.words.new = []
        small = self.lexicon.vocabulary
        ranks = [self.rank.get(w, -1) for w in new]
        item = [r if 0 <= r < small else small + bucket_of(w) for w, r in zip(new, ranks)]
        ranks = np.array(ranks, np.int64)
        logs = np.zeros(len(ranks))
        logs[ranks >= 0] = self.log_counts[ranks[ranks >= 0]]
        self.spelled += new
        self.item = np.concatenate([self.item, np.array(item, np.int64)])
        self.log_count = np.concatenate([self.log_count, logs])
        self.rare = np.concatenate([self.rare, ranks < 0])

    def encode(self, texts: list[bytes]) -> list[pa.Array]:
        """Of each text: tokens, those with a known count, sum of log10(c + 1) over these, the same for words in buckets, items, rare words and their numbers."""
        if len(self.words) > MEMO:
            self.reset()
        get, lexicon, flat, sizes = self.words.__getitem__, self.lexicon, [], []
        for text in texts:
            before = len(flat)
            flat += map(get, words_of(text))
            sizes.append(len(flat) - before)
        if self.words.new:
            self.learn()
        ids, sizes, n = np.array(flat, np.int64), np.array(sizes, np.int64), len(texts)
        doc = np.repeat(np.arange(n), sizes)
        logs, rare, items = self.log_count[ids], self.rare[ids], self.item[ids]
        dtype = item_type(lexicon.vocabulary)
        data = np.full(len(ids) + n, lexicon.end, dtype)
        data[np.arange(len(ids)) + doc] = items
        cuts = np.concatenate([[0], np.cumsum(sizes + 1)]) * np.dtype(dtype).itemsize
        pairs, times = np.unique(doc[rare] * (len(self.spelled) + 1) + ids[rare], return_counts=True)
        of, word = pairs // (len(self.spelled) + 1), pairs % (len(self.spelled) + 1)
        offsets = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
        spelled = self.spelled
        return [
            pa.array(sizes + 1),
            pa.array(np.bincount(doc[~rare], minlength=n) + int(lexicon.ends > 0)),
            pa.array(np.bincount(doc, logs, n) + np.log10(lexicon.ends + 1.0), pa.float64()),
            pa.array(np.bincount(doc, np.where(items >= lexicon.vocabulary, logs, 0.0), n).astype(np.float64)),
            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]),
            pa.ListArray.from_arrays(offsets, pa.array([spelled[w] for w in word.tolist()], pa.binary()).cast(pa.string())),
            pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
        ]


def log_probabilities(items: list[bytes], model: Model) -> np.ndarray:
    """log10 probability of each text, with counts of words in buckets taken as 0."""
    lexicon = model.lexicon
    stream, at = stream_of(items, lexicon.vocabulary)
    logs = np.empty(len(at))
    for k in range(0, len(at), STEP_TOKENS):
        part = at[k : k + STEP_TOKENS]
        p = class_probabilities(model.weights, model.bias, features(stream, part, lexicon.slots))
        logs[k : k + STEP_TOKENS] = np.log10(np.maximum(p[np.arange(len(part)), model.classes[stream[part]]], 1e-30))
    logs += model.token_log[stream[at]]
    sizes = np.array([len(x) // np.dtype(item_type(lexicon.vocabulary)).itemsize for x in items])
    return np.add.reduceat(logs, np.cumsum(sizes) - sizes)


_ENCODED = "n bigint, known bigint, logs double, oov double, items binary, rare array<string>, times array<int>"


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``training`` says of which rows the model learns.
    """
    spark: SparkSession = docs.sparkSession
    shelf = Shelf(spark, "lm")
    texts = docs.where(training).select(F.col(text_col).alias("text"))
    counts = shelf.put(word_counts(texts), "counts")
    lexicon = lexicon_of(texts, counts)
    known = spark.sparkContext.broadcast(lexicon)
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = Encoder(known.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, 300):
                piece = batch.slice(k, 300)
                rows = np.arange(row, row + piece.num_rows)
                row += piece.num_rows
                found = encoder.encode(as_bytes(piece.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(rows), piece.column(0), piece.column(2), *found], names=["row", "id", "training", "n", "known", "logs", "oov", "items", "rare", "times"])

    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    encoded = shelf.put(marked.mapInArrow(freeing(encode), f"row bigint, id {id_type}, training boolean, {_ENCODED}"), "encoded")
    model = train(encoded.where("training").select("items"), counts, lexicon)
    sent = spark.sparkContext.broadcast(model)

    def scorer():
        model = sent.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            items = batch.column(6).to_pylist()
            found = [log_probabilities(items[k : k + 100], model) for k in range(0, len(items), 100)]
            prob = np.concatenate(found) + batch.column(5).to_numpy()
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(prob)], names=["row", "id", "n", "known", "logs", "prob"])

        return one

    scored = map_batches(encoded.select("row", "id", "n", "known", "logs", "oov", "items"), scorer, f"row bigint, id {id_type}, n bigint, known bigint, logs double, prob double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("e")).select("row", F.col("e.rare").alias("word"), F.col("e.times").alias("times"))
    sums = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.round(F.col("times") * F.log10(F.col("c") + 1) * FIXED).cast("bigint")).alias("more_logs"))
    more, more_logs = F.coalesce("more", F.lit(0)), F.coalesce("more_logs", F.lit(0)) / FIXED
    return scored.join(sums, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        (F.col("known") + more).alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n") * F.lit(float(np.log10(lexicon.total + lexicon.distinct + 1)))).alias("base_score"),
        (F.col("prob") + more_logs).alias("score"),
    )
