"""Language identification with segmentation-marginalised unigrams.

The vocabulary is that of a public tokenizer.  For each language the model holds
a probability for every piece; a word's likelihood is the sum over all its
segmentations into pieces, computed by a forward pass, and a text's likelihood
is the product over its words.  Probabilities are learned by expectation
maximisation: forward-backward passes give expected piece counts over all
segmentations.

Training reads at most about ``sample_per_lang`` labelled documents of each
language (chosen by a hash of the id).  Counting words and every E-step are
distributed; what reaches the driver is one number for each language and piece.
Prediction is one pass of Arrow batches without a shuffle, and words already
met in a task are looked up.

Defined cases: null text, empty text and text without a letter give ``und`` with
score 0; rows with a null language or null text teach nothing; with nothing to
learn from, every row is ``und``; ties go to the first language in code point
order; a run of letters of any length is one word, summed over all its
segmentations in time linear in its length; equal texts get equal results; an
empty table gives an empty result; other columns are neither read nor returned,
so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.shared import Shelf, as_texts, freeing, map_batches

START = "▁"
#: Words of up to so many letters are summed together, longer ones each on its own with logarithms.
SHORT = 32
#: Letters, and a few numerals such as fractions, which ``letters_of`` leaves out.
_WORD = re.compile(r"[^\W\d_]+")
#: Words a task keeps before it starts over.
MEMO = 400_000
UNKNOWN = 0


def vocabulary(path: str) -> list[str]:
    """Pieces of lower-case letters, with or without the word start mark; index 0 is the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return ["<unk>", *sorted(p for p in pieces if p and all(c.isalpha() for c in p.removeprefix(START)))]


class Lattice:
    """All segmentations of words of one length, as piece ids by start and size."""

    def __init__(self, index: dict[str, int], words: list[str], max_piece: int):
        missing = len(index)
        size = len(words[0])
        get = index.get
        self.size, self.edges = size, []
        for end in range(1, size + 1):
            for begin in range(max(0, end - max_piece), end):
                ids = np.fromiter([get(w[begin:end], missing) for w in words], np.int32, len(words))
                if end - begin == 1:
                    ids[ids == missing] = UNKNOWN
                elif (ids == missing).all():
                    continue
                self.edges.append((begin, end, ids))


def forward(lattice: Lattice, probs: np.ndarray, n: int) -> np.ndarray:
    """alpha[position, word, language]; ``probs`` has a last row of zeros for missing pieces."""
    alpha = np.zeros((lattice.size + 1, n, probs.shape[1]))
    alpha[0] = 1
    for begin, end, ids in lattice.edges:
        alpha[end] += alpha[begin] * probs[ids]
    return alpha


class LongWord:
    """All segmentations of one word, for sums in logarithms."""

    def __init__(self, word: str, index: dict[str, int], log_probs: np.ndarray, max_piece: int):
        self.size, self.log_probs, self.into = len(word), log_probs, []  # by end: (starts, piece ids)
        for end in range(1, self.size + 1):
            found = [(b, i) for b in range(max(0, end - max_piece), end) if (i := index.get(word[b:end], UNKNOWN if end - b == 1 else None)) is not None]
            self.into.append((np.array([b for b, _ in found]), np.array([i for _, i in found])))

    def forward(self) -> np.ndarray:
        """log alpha[position, language]"""
        alpha = np.full((self.size + 1, self.log_probs.shape[1]), -np.inf)
        alpha[0] = 0
        for end, (begin, ids) in enumerate(self.into, 1):
            alpha[end] = np.logaddexp.reduce(alpha[begin] + self.log_probs[ids], axis=0)
        return alpha

    def add_expected(self, out: np.ndarray, counts: np.ndarray) -> None:
        """Add the expected piece counts of the word, seen ``counts`` times by language."""
        alpha = self.forward()
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        for end in range(self.size, 0, -1):
            begin, ids = self.into[end - 1]
            step = self.log_probs[ids] + beta[end]
            beta[begin] = np.logaddexp(beta[begin], step)
            np.add.at(out, ids, np.exp(alpha[begin] + step - alpha[-1]) * counts)


def by_length(words: list[str]) -> tuple[dict[int, list[int]], list[int]]:
    """Places of short words by length, and those of long ones."""
    groups, long = defaultdict(list), []
    for i, w in enumerate(words):
        (groups[len(w)] if len(w) <= SHORT else long).append(i)
    return groups, long


def _logs(probs: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(probs, 1e-300))


def word_scores(words: list[str], index: dict[str, int], probs: np.ndarray, max_piece: int) -> np.ndarray:
    """log probability of each word in each language."""
    out = np.empty((len(words), probs.shape[1]))
    groups, long = by_length(words)
    logs = _logs(probs) if long else None
    for i in long:
        out[i] = LongWord(words[i], index, logs, max_piece).forward()[-1]
    for at in groups.values():
        for k in range(0, len(at), 20_000):
            part = at[k : k + 20_000]
            alpha = forward(Lattice(index, [words[i] for i in part], max_piece), probs, len(part))
            out[part] = np.log(np.maximum(alpha[-1], 1e-300))
    return out


def expected_counts(words: list[str], counts: np.ndarray, index: dict[str, int], probs: np.ndarray, max_piece: int) -> np.ndarray:
    """Expected piece counts by language; counts[word, language]."""
    out = np.zeros_like(probs)
    groups, long = by_length(words)
    logs = _logs(probs) if long else None
    for i in long:
        LongWord(words[i], index, logs, max_piece).add_expected(out, counts[i])
    for at in groups.values():
        for k in range(0, len(at), 5000):
            part = at[k : k + 5000]
            lattice = Lattice(index, [words[i] for i in part], max_piece)
            alpha = forward(lattice, probs, len(part))
            beta = np.zeros_like(alpha)
            beta[-1] = counts[part] / np.maximum(alpha[-1], 1e-300)
            shares = []
            for begin, end, ids in reversed(lattice.edges):
                step = probs[ids] * beta[end]
                shares.append(alpha[begin] * step)
                beta[begin] += step
            ids, shares = np.concatenate([e[2] for e in reversed(lattice.edges)]), np.concatenate(shares)
            for lang in range(probs.shape[1]):
                out[:, lang] += np.bincount(ids, shares[:, lang], len(out))
    out[-1] = 0
    return out


def letters_of(run: str) -> list[str]:
    """The runs of letters in what ``_WORD`` finds."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def words_of(text: str) -> list[str]:
    return [START + w for run in _WORD.findall(text.lower()) for w in letters_of(run)]


class LanguageModel:
    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray):
        self.langs, self.pieces, self.probs = langs, pieces, probs


def fit(labelled: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 3000, rounds: int = 3) -> LanguageModel:
    """Learn from rows with text and language."""
    spark = labelled.sparkSession
    shelf = Shelf(spark, "langid")
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, pieces = sorted(sizes), vocabulary(vocab_path)
    if not langs:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    max_piece = max(map(len, pieces))
    at = {x: i for i, x in enumerate(langs)}
    rates = F.lit(0.0)
    for lang, n in sizes.items():
        rates = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_per_lang / n))).otherwise(rates)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rates * (1 << 20))

    def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def flushed() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["lang", "word", "n"])

        for batch in batches:
            for text, lang in zip(as_texts(batch.column(0)), batch.column(1).to_pylist()):
                found[lang].update(words_of(text))
            if sum(map(len, found.values())) > MEMO:
                yield flushed()
        if any(found.values()):
            yield flushed()

    counted = sample.select("text", "lang").mapInArrow(freeing(counter), "lang string, word string, n bigint")
    words = shelf.put(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    index = {p: i for i, p in enumerate(pieces)}
    probs = np.full((len(pieces) + 1, len(langs)), 1 / len(pieces))
    probs[-1] = 0
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((index, probs))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, probs = sent.value
            total = np.zeros_like(probs)
            row: dict[str, int] = {}
            cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def add() -> None:
                counts = np.zeros((len(row), probs.shape[1]))
                for word, lang, n in cells:
                    np.add.at(counts, (word, lang), n)
                np.add(total, expected_counts(list(row), counts, index, probs, max_piece), out=total)
                row.clear()
                cells.clear()

            for batch in batches:
                ids = np.array([row.setdefault(w, len(row)) for w in batch.column(1).to_pylist()], np.int64)
                cells.append((ids, np.array([at[x] for x in batch.column(0).to_pylist()], np.int64), batch.column(2).to_numpy()))
                if len(row) > 50_000:
                    add()
            if row:
                add()
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], names=["piece", "lang", "n"])

        totals = words.mapInArrow(freeing(expect), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(probs)
        counts[totals["piece"], totals["lang"]] = totals["n"]
        counts[:-1] += 0.05
        probs = counts / counts.sum(axis=0)
        sent.unpersist()
    return LanguageModel(langs, pieces, probs)


class _Index(dict):
    """Numbers words as they come, and remembers which are new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row: the likeliest language and its posterior under equal priors."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        langs, probs = model.langs, model.probs
        index = {p: i for i, p in enumerate(model.pieces)}
        max_piece = max(map(len, model.pieces))
        state = {"memo": _Index(), "table": np.zeros((0, len(langs))), "letters": np.zeros(0, bool)}

        def learn(runs: list[str]) -> None:
            parts = [[START + w for w in letters_of(run)] for run in runs]
            sizes = np.array([len(x) for x in parts])
            scores = word_scores([w for x in parts for w in x], index, probs, max_piece)
            if (sizes != 1).any():
                new = np.zeros((len(runs), len(langs)))
                np.add.at(new, np.repeat(np.arange(len(runs)), sizes), scores)
                scores = new
            state["table"] = np.concatenate([state["table"], scores])
            state["letters"] = np.concatenate([state["letters"], sizes > 0])

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_texts(batch.column(1))
            preds, scores = ["und"] * len(texts), np.zeros(len(texts))
            if langs:
                for lo in range(0, len(texts), 500):
                    if len(state["memo"]) > MEMO:
                        state["memo"], state["table"], state["letters"] = _Index(), np.zeros((0, len(langs))), np.zeros(0, bool)
                    memo = state["memo"]
                    ids = [list(map(memo.__getitem__, _WORD.findall(t.lower()))) for t in texts[lo : lo + 500]]
                    if memo.new:
                        learn(memo.new)
                        memo.new = []
                    for i, own in enumerate(ids, lo):
                        if own and state["letters"][own].any():
                            total = state["table"][own].sum(axis=0)
                            best = int(np.argmax(total))
                            preds[i] = langs[best]
                            scores[i] = 1 / np.exp(total - total[best]).sum()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

        return one

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {id_type}, lang_pred string, score double")
