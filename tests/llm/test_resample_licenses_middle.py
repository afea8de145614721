"""Resampling, licence scan and fill-in-the-middle against plain programs."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from setforge.llm import fill_in_middle, licenses, resample
from tests_llm_words import prose

SCHEMA = "doc_id bigint, text string, score string, `n` int, rank int, labels string"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    out = [None, "", " \n", "ONE", "Ünï-Códe 漢字 🙂 x", "<P> " * 30, "a<S", "  leading and trailing \n\n"]
    for i in range(150):
        text = prose(rng, rng.randint(1, 60))
        if i % 5 == 1:
            text = "common words of the target " * rng.randint(1, 9) + text
        if i % 7 == 2:
            text = out[-1] or ""
        if i % 4 == 3:
            _, wording, _ = rng.choice(licenses.TEMPLATES)
            words = wording.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["changed", "the", words[0]])
            text += ".\n" + " ".join(words) + ". " + prose(rng, 5) + (" MIT-License, apache license" if i % 8 == 7 else "")
        out.append(text)
    out.append(prose(rng, 90_000) + " Released under the MIT License " + "general public license " * 40_000)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in enumerate(texts)], SCHEMA).repartition(5).persist()


# ---- resampling -----------------------------------------------------------


def brute_resample(rows, target, longest, buckets, min_words, percent, seed):
    def found(text):
        words = WORDS.findall(lowered(text))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    of = [(i, *found(t)) for i, t in rows]
    s, t = collections.Counter(b for _, _, f in of for b in f), collections.Counter(b for x in target for b in found(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    out = {}
    for i, n, f in of:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i] = [n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None]
    able = sorted((i for i in out if out[i][0] >= min_words), key=lambda i: (-out[i][3], i))
    for k, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][4] = k
    return {i: tuple(v) for i, v in out.items()}


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 50, 40), (1, 1, 100), (2, 1000, 0)])
def test_resample(spark, docs, texts, longest, buckets, percent):
    target = ["common words of the target", None, "And the COMMON, other ones"]
    got, at = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets, percent=percent)
    assert set(docs.columns) <= set(got.columns) and at["score"] != "score"
    found = {r["doc_id"]: tuple(r[at[c]] for c in ("n_words", "n_features", "weight", "score", "rank")) for r in got.collect()}
    assert found == brute_resample(list(enumerate(texts)), target, longest, buckets, 20, percent, "2024")


def test_resample_without_target(spark, docs, texts):
    got, at = resample.resample(docs, spark.createDataFrame([], "text string"), with_text=False)
    assert "text" not in got.columns
    found = {r["doc_id"]: tuple(r[at[c]] for c in ("n_words", "n_features", "weight", "score", "rank")) for r in got.collect()}
    assert found == brute_resample(list(enumerate(texts)), [], 1, 10_000, 20, 10, "2024")


def test_many_rows_of_one_score(spark):
    """Equal rows are ranked each on its own, and spread over ranges although score and id are equal."""
    same, text = 3000, "the same words again and again " * 5
    rows = spark.range(same).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.range(100, 400).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")))
    got, at = resample.resample(rows, spark.createDataFrame([("other",)], "text string"), percent=97)
    found = got.select("doc_id", F.col(at["rank"]).alias("rank"), F.col(at["score"]).alias("score")).collect()
    drawn = sorted((r["rank"], r["score"], r["doc_id"]) for r in found if r["rank"] is not None)
    assert [r[0] for r in drawn] == list(range(1, 97 * 3300 // 100 + 1))
    assert [r[1:] for r in drawn] == sorted((r[1:] for r in drawn), key=lambda x: (-x[0], x[1]))


# ---- licences -------------------------------------------------------------


def brute_licenses(texts):
    words_of = {i: WORDS.findall(lowered(t)) for i, t in enumerate(texts)}
    df = collections.Counter(w for words in words_of.values() for w in set(words))
    out = {}
    for i, words in words_of.items():
        at = collections.defaultdict(list)
        for p, w in enumerate(words):
            at[w].append(p)

        def places(phrase):
            parts = WORDS.findall(lowered(phrase))
            return [p for p in at[parts[0]] if words[p : p + len(parts)] == parts]

        base = [(p, label) for phrase, label in licenses.BASE for p in places(phrase)]
        labels, score = {label for _, label in base}, 0.5 if base else 0.0
        for label, wording, phrases in licenses.TEMPLATES:
            own = WORDS.findall(lowered(wording))
            held = []
            for phrase in phrases:
                parts = WORDS.findall(lowered(phrase))
                q = next(q for q in range(len(own)) if own[q : q + len(parts)] == parts)
                held.append({p - q for p in places(phrase)})
            if not all(held):
                continue
            rare = sorted({w for w in own if at.get(w)}, key=lambda w: (df[w], w.encode()))[: licenses.RARE]
            offsets = [{p - q for p in at[w] for q, v in enumerate(own) if v == w} for w in rare]
            whole, slack = min(licenses.RARE, len(set(own))), 1 + len(own) // 8
            for start in set().union(*offsets, *held):
                band = range(start, start + slack + 1)
                votes = sum(any(x in o for x in band) for o in offsets)
                if 2 * votes >= whole and all(any(x in h for x in band) for h in held):
                    labels.add(label)
                    score = max(score, votes / whole)
        starts = [p for p, _ in base]
        out[i] = (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score)
    return out


def test_licenses(docs, texts):
    got, at = licenses.scan_licenses(docs)
    assert set(docs.columns) <= set(got.columns) and at["labels"] != "labels"
    rows = got.collect()
    found = {r["doc_id"]: tuple(r[at[c]] for c in licenses.FIELDS[:7]) for r in rows}
    assert found == brute_licenses(texts)
    assert {m["label"] for r in rows for m in r[at["matches"]]} >= {"mit", "apache-2.0", "gpl-3.0", "bsd", "cc-by-nc-4.0"}
    assert all(m["share"] >= 0.5 for r in rows for m in r[at["matches"]])


def test_every_wording_is_found(spark):
    rows = [(i, f"some words before {text}, and some after", label) for i, (label, text, _) in enumerate(licenses.TEMPLATES)]
    got, at = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string, label string"), with_text=False)
    for r in got.collect():
        assert r["label"] in r[at["labels"]].split(",") and r[at["score"]] == 1.0
        assert {"label": r["label"], "start": 3, "share": 1.0} in [m.asDict() for m in r[at["matches"]]]


def test_edited_and_incomplete_notices(spark):
    _, mit, _ = licenses.TEMPLATES[1]
    words = mit.split()
    edited = " ".join(w for k, w in enumerate(words) if k not in (12, 17, 40))
    rows = [(0, edited), (1, mit.replace("without restriction", "with care")), (2, " ".join(reversed(words))), (3, mit[: len(mit) // 3])]
    got, at = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string"))
    assert {r["doc_id"]: r[at["labels"]] for r in got.collect()} == {0: "mit", 1: "", 2: "", 3: ""}


def test_wordings_need_their_phrases():
    with pytest.raises(ValueError):
        licenses.Template.of("x", "some wording", ("another phrase",))
    with pytest.raises(ValueError):
        licenses.Template.of("x", "some wording", ())


# ---- fill in the middle ---------------------------------------------------


def brute_middle(doc_id, text, fim, spm):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("fim, spm", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_middle(docs, texts, fim, spm):
    got, at = fill_in_middle.fill_in_middle(docs, fim_percent=fim, spm_percent=spm, with_digests=True)
    assert set(docs.columns) <= set(got.columns) and at["n"] != "n"
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        want = brute_middle(r["doc_id"], text, fim, spm)
        assert tuple(r[at[c]] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == want
        assert r[at["output_sha256"]] == hashlib.sha256(want[-1].encode()).hexdigest()
        assert r[at["restored_sha256"]] == hashlib.sha256(text.encode()).hexdigest()
        assert fill_in_middle.restore(r[at["output"]], r[at["form"]]) == text


def test_markers_across_borders():
    """Pieces that end like a marker's beginning do not mislead the restoring."""
    for k in range(400):
        text = "<S <M <P> x"[: k % 7 + 1].replace("<P>", "<P") + " a <S b <M c"
        _, form, _, _, output = fill_in_middle.transform(k, text, "42", 100, 50)
        assert fill_in_middle.restore(output, form) == text
