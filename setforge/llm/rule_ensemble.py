"""A quality classifier made of rules.

Shallow trees are boosted on a bounded labelled sample; every path from a root
to a node is a conjunctive rule over text statistics.  A lasso logistic fit
weighs the rules and drops most of them.  What remains is compiled into Spark
column expressions, so scoring is a projection inside the JVM: no shuffle, no
Python.

The fit reads at most about ``sample`` labelled rows (chosen by a hash of the
id); their ids are the only thing broadcast, and their statistics the only thing
the driver collects.

Defined cases: null text is empty text; ratios with nothing to divide by are 0;
labels that are null are ignored, and of repeated labels the largest counts;
without labels of both kinds the score is the smoothed share of label 1 for every
row (0.5 without labels); an empty table gives an empty result; repeated rows of
documents are scored each on its own, and each counts in the fit if labelled; long
texts are measured whole; other columns are neither read nor returned, so their
names cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Counts of one text; each scans it once."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    lines = F.split(text, "\n")
    words = F.split(F.trim(F.regexp_replace(text, BLANK, " ")), " ")
    return {
        "chars": F.length(text).cast("double"),
        "words": count(r"[^\x20\x09-\x0D]+"),
        "letters": (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))).cast("double"),
        "digits": count("[0-9]"),
        "symbols": count(r"[#*$%&<>{}\[\]=_\\~^@]"),
        "bars": count(r"\|"),
        "uppers": count(r"\p{Lu}"),
        "stops": count("[.!?]"),
        "commas": count("[,;:]"),
        "lines": F.size(lines).cast("double"),
        "kinds_of_line": F.size(F.array_distinct(lines)).cast("double"),
        "kinds_of_word": F.size(F.array_distinct(words)).cast("double"),
    }


def _per(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def features() -> dict[str, Column]:
    """What the rules compare, over the columns of ``statistics``."""
    return {
        "log_words": F.log1p("words"),
        "word_length": _per("letters", "words"),
        "letter_share": _per("letters", "chars"),
        "digit_share": _per("digits", "chars"),
        "symbols_a_word": _per("symbols", "words"),
        "bars_a_word": _per("bars", "words"),
        "upper_share": _per("uppers", "letters"),
        "stops_a_word": _per("stops", "words"),
        "commas_a_word": _per("commas", "words"),
        "words_a_line": _per("words", "lines"),
        "line_variety": _per("kinds_of_line", "lines"),
        "word_variety": _per("kinds_of_word", "words"),
    }


@dataclass(frozen=True)
class Rule:
    """All of ``feature > cut`` (or <=, where ``above`` is false)."""

    tests: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, cut in self.tests:
            out &= (x[:, names.index(name)] > cut) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, cut in self.tests:
            out = out & ((F.col(name) > cut) if above else (F.col(name) <= cut))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def logit(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return total


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, names: list[str], cuts: list[np.ndarray], depth: int, least: int, tests: tuple, rules: list[Rule]) -> np.ndarray:
    """Fit a tree by second-order gain, collect its paths, and give its values."""
    out = np.full(len(x), -grad.sum() / (hess.sum() + 1.0))
    if tests:
        rules.append(Rule(tests))
    if depth == 0 or len(x) < 2 * least:
        return out
    best = (1e-6, -1, 0.0)
    parent = grad.sum() ** 2 / (hess.sum() + 1)
    for j, options in enumerate(cuts):
        if not len(options):
            continue
        slot = np.searchsorted(options, x[:, j], side="left")  # x > options[k] exactly when slot > k
        g, h, n = (np.bincount(slot, w, len(options) + 1).cumsum()[:-1] for w in (grad, hess, None))
        gain = g**2 / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1) - parent
        gain[(n < least) | (len(x) - n < least)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], j, float(options[k]))
    if best[1] < 0:
        return out
    above = x[:, best[1]] > best[2]
    for side in (True, False):
        own = above == side
        out[own] = _grow(x[own], grad[own], hess[own], names, cuts, depth - 1, least, (*tests, (names[best[1]], side, best[2])), rules)
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Boost trees, then weigh their rules by lasso logistic regression."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = math.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return RuleModel(bias, ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 34)[1:-1])) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    rules: list[Rule] = []
    logit = np.full(len(y), bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        own = rng.random(len(y)) < 0.6
        _grow(x[own], (p - y)[own], (p * (1 - p))[own], names, cuts, depth, max(5, len(y) // 200), (), grown := [])
        found = list(dict.fromkeys(grown))
        rules += found
        if not found:
            continue
        fitted = _refit(x, p - y, p * (1 - p), names, found)
        logit += 0.3 * fitted
    rules = list(dict.fromkeys(rules))
    if not rules:
        return RuleModel(bias, ())
    held = np.column_stack([r.holds(x, names) for r in rules]).astype(float)
    mean, scale = held.mean(axis=0), held.std(axis=0)
    use = scale > 0
    z, rules = (held[:, use] - mean[use]) / scale[use], [r for r, u in zip(rules, use) if u]
    weights, intercept = _lasso(z, y, bias, penalty)
    raw = weights / scale[use]
    keep = np.abs(weights) > 1e-6
    return RuleModel(float(intercept - (raw * mean[use]).sum()), tuple((r, float(w)) for r, w, k in zip(rules, raw, keep) if k))


def _refit(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, names: list[str], rules: list[Rule]) -> np.ndarray:
    """Leaf values of a tree over all rows: the deepest rule that holds decides."""
    out = np.full(len(x), -grad.sum() / (hess.sum() + 1))
    for rule in sorted(rules, key=lambda r: len(r.tests)):
        own = rule.holds(x, names)
        out[own] = -grad[own].sum() / (hess[own].sum() + 1)
    return out


def _lasso(z: np.ndarray, y: np.ndarray, bias: float, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient."""
    n, k = z.shape
    gram = z.T @ z / n
    step = 1 / (0.25 * float(np.linalg.eigvalsh(gram)[-1]) + 0.25)
    w = v = np.zeros(k)
    b = bias
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ v + b)))
        new = v - step * (z.T @ (p - y) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= step * float((p - y).mean())
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_next * (new - w)
        w, t = new, t_next
    return w, b


def with_features(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The kept columns and the features; statistics are computed once a row."""
    stats = docs.select(*keep, F.struct(*(c.alias(n) for n, c in statistics(F.col(text_col)).items())).alias("__stats"))
    kept = stats.columns[:-1]
    flat = stats.select(*kept, *(F.col(f"__stats.{n}").alias(n) for n in statistics(F.lit(""))))
    return flat.select(*kept, *(c.alias(n) for n, c in features().items()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> RuleModel:
    """Learn from labelled rows; labels has id_col and label_col (0 or 1)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__of")).agg(F.max(label_col).alias("__label"))
    total = known.count()
    rate = min(1.0, sample / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64("__of"), F.lit(1 << 20)) < rate * (1 << 20))
    labelled = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("__of"))
    names = list(features())
    rows = with_features(labelled, text_col, [F.col("__label")]).toPandas()
    if not len(rows):
        return RuleModel(0.0, ())
    rows = rows.sort_values(rows.columns.tolist())
    return fit_rules(rows[names].to_numpy(float), rows["__label"].to_numpy(float), names)


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; score is the probability of label 1."""
    rows = with_features(docs, text_col, [F.col(id_col).alias("__id")])
    return rows.select(F.col("__id").alias(id_col), (1 / (1 + F.exp(-model.logit()))).alias("score"))
