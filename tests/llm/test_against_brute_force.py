"""Operators against plain programs on small fixtures with planted cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from setforge.llm import components, fingerprints, langid, lm, mixing, near_dedup, packing, pii, quality_rules, rule_ensemble, substring_dedup
from setforge.llm.shared import Shelf

SYLLABLES = {"en": "the ing tion er th an wh st ou re".split(), "fr": "eau que les ai ou ment oir é tre la".split(), "de": "ung sch ein der keit ß ü ver ge zu".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = []
    passage = prose(rng, "en", 60)
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        text = prose(rng, lang, rng.randint(5, 150))
        if i % 6 == 5:
            words = out[rng.randrange(len(out))][0].split()
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 11 == 3:
            text = out[rng.randrange(len(out))][0]
        if i % 9 == 4:
            text += "\n" + passage + "\n" + prose(rng, lang, 20)
        out.append((text, lang))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, lang, f"s{i % 5}" if i % 17 else None) for i, (t, lang) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5).persist()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---- near-duplicates ------------------------------------------------------


def brute_components(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, texts, width):
    sets = {}
    for i, (t, _) in enumerate(texts):
        w = words(lowered(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}
    want = brute_components(sets, 80)
    got = near_dedup.near_duplicates(docs, width=width).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)
    assert len(set(want.values())) < len(want)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = prose(rng, "en", 200).split()
    rows = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(200)] = f"own{i}"
        own[rng.randrange(200)] = f"other{i}"
        rows.append((i, " ".join(own)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_large_stars_are_whole(spark):
    rng = random.Random(21)
    rows, sets = [], {}
    for star, at in enumerate((0, 75, 150)):  # where the source's id lies among its edits
        base = prose(rng, "en", 300).split()
        for k in range(151):
            own = list(base)
            for e in () if k == at else range(5):
                own[10 + 56 * e + rng.randrange(50)] = f"own{star}x{k}x{e}"
            i = 1000 * star + k
            rows.append((i, " ".join(own)))
            w = lowered(" ".join(own)).split()
            sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    want = brute_components(sets, 80)
    assert set(want.values()) == {0, 1000, 2000}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_pairs_inside_one_boilerplate(spark):
    # between pairs the common text is just below the threshold, within them just above
    rng = random.Random(31)
    plate = [f"p{k}" for k in range(300)]
    rows = [(2 * k + side, " ".join([*plate, *(f"o{k}x{j}" for j in range(14)), *(f"s{k}y{side}z{j}" for j in range(28))])) for k in range(300) for side in (0, 1)]
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows[:4]}
    assert len(sets[0] & sets[2]) < 0.8 * len(sets[0] | sets[2]) < 0.8 * len(sets[0] | sets[1]) * 1.1 and len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


def test_rows_without_ids(spark):
    same, near = "one text of more than five words here " * 2, "quite another text of seven words " * 2
    rows = [(None, same), (3, same), (None, near), (None, near), (5, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (0, 3, False), (3, 3, True), (5, 5, True)]


def test_cut_regions_are_named(spark):
    sig = bytes(range(32))
    orders = spark.createDataFrame([(0, bytearray(sig), i) for i in range(6)], "tree int, sig binary, id bigint").repartitionByRange(3, "id").sortWithinPartitions("id")
    edges = {r["edge"] for r in near_dedup.neighbours(orders).where("edge IS NOT NULL").collect()}
    classes = spark.createDataFrame([(1, 9, bytearray(sig * near_dedup.TREES))], "id bigint, n bigint, sig binary")
    assert edges == {r["region"] for r in near_dedup.members(classes).where("tree = 0").collect()}


def test_chains_are_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components.components(edges, Shelf(spark, "t")).collect()}
    assert all(found[i] == i // 20 * 20 for i in found) and len(found) == 57


# ---- repeated strings -----------------------------------------------------


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                gone[p : p + 50] = True
        seen |= {b[p : p + 50] for p in range(len(b) - 49)}
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings(docs, texts):
    want = brute_repeats([(i, t) for i, (t, _) in enumerate(texts)])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000


def test_repeated_strings_of_few_letters(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) + "a" * rng.randint(0, 140)) for i in range(60)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_repeats(rows)


def test_multikey_order():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (500, 7)).astype(np.uint64)
    order = substring_dedup.multikey_order(keys)
    assert [tuple(k) for k in keys[order].tolist()] == sorted(tuple(k) for k in keys.tolist())


def repeats_of(spark, rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 0.0])
def test_a_passage_in_half_of_all_documents(spark, monkeypatch, hot):
    # the second run splits every gram that the sample has more than eight times
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def some(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, pair = some(40), "therefore nevertheless"
    rows = []
    for i in range(2000):
        body = some(rng.randint(5, 40))
        rows.append((i * 7 % 2000, f"{body} {passage} {some(5)}" if i % 2 else f"{body} {pair} {some(9)} {pair}"))
    rows += [(3000 + i, rows[i % 3][1]) for i in range(50)]
    assert repeats_of(spark, rows) == brute_repeats(rows)


def test_copies_keep_the_smallest_id_only(spark):
    text = "the same sixty bytes or more of text in every one of these rows, twice"
    rows = [(9, text), (4, text), (4, text), (7, text), (2, "short"), (3, "short"), (5, None)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in found) == sorted([(9, 70, 70), (4, 70, 0), (4, 70, 0), (7, 70, 70), (2, 5, 0), (3, 5, 0), (5, 0, 0)])


# ---- personal data --------------------------------------------------------


def brute_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


PLANTED = [
    "write to a.b+c@mail.example.com, or x@y; or a@b.c@d.e", "10.0.0.1 and 1.2.3.4.5.6.7.8 and 300.1.1.1 and 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (974) 555-3436 or +49 30 1234567+12 345", "é@ü.de é ab@cd-.e.f.", "@@a@b..c a@b.-", "+" * 30 + "1" * 40, "..%%@x.y z@x.y.",
]


def test_base_spans_equal_regular_expressions():
    rng = random.Random(8)
    for text in PLANTED + ["".join(rng.choice("a1.@+- 9(x%") for _ in range(rng.randint(0, 80))) for _ in range(4000)]:
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == brute_spans(text), text


def test_method_adds_accounts_and_urls():
    kinds = lambda t: {s[0]: t[s[1] : s[2]] for s in pii.find_spans(t)}
    assert kinds('token = "04dbebab91ab85687d33"')["account"] == "04dbebab91ab85687d33"
    assert kinds("IBAN: GB82 WEST 1234 5698 7654 32 thanks")["account"] == "GB82 WEST 1234 5698 7654 32"
    assert "url" in kinds("see https://user:pw@host.example/x now")
    assert not pii.find_spans("the token of the secret account is lost, see https://example.org")


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd or +1 (974) 555-3436")], "doc_id bigint, text string")
    assert pii.redact(df).first()["text"] == "mail <EMAIL> or <PHONE>"


# ---- quality --------------------------------------------------------------


def test_repeated_words_against_all_windows():
    rng = random.Random(1)
    for _ in range(60):
        w = [rng.choice("ab").encode() for _ in range(rng.randint(0, 40))]
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        assert quality_rules.repeated_words(w) == len(covered)


def test_bad_hosts_are_rejected_and_good_ones_kept(spark, tmp_path):
    import duckdb

    from setforge.llm import queries

    rng = random.Random(6)

    def page(k, kind):
        body = prose(rng, "en", 60)
        if kind == "short":
            return body if k % 10 < 2 else prose(rng, "en", 3)
        if kind == "symbols":  # fails no base rule
            return body if k % 10 < 5 else body + " " + "#$%& " * 15
        return body + "\nshare this\nshare this" if kind == "lines" and k % 10 < 1 else body

    hosts = {"short": "short", "symbols": "symbols", None: "symbols", "good": "lines", **{f"good{k}": "good" for k in range(6)}}
    rows = [(100 * h + k, page(k, kind), host) for h, (host, kind) in enumerate(hosts.items()) for k in range(100)]
    rows += [(9000, page(9, "symbols"), "tiny"), (9001, None, "good"), (9002, "", "good")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    judged, at = quality_rules.quality_rules(docs)
    found = judged.collect()
    bad = {"short", "symbols", None}
    assert all(r[at["kept"]] == (not r[at["base_failed"]] and r["source"] not in bad) for r in found)
    assert sum(not r[at["kept"]] and not r[at["base_failed"]] for r in found) == 220
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op8_quality_rules(spark, str(tmp_path)).select("doc_id", "base_failed", "kept", "n_words").collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.execute(f"SELECT doc_id, base_failed, kept, n_words FROM ({queries.OP8_SQL})").fetchall())


def test_rule_ensemble_learns(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = prose(rng, "en", rng.randint(20, 80))
        rows.append((i, text if good else " | ".join(text.split())))
        labels.append((i, int(good)))
    df, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = rule_ensemble.fit(df.where("doc_id < 300"), lab)
    got = {r["doc_id"]: r["score"] for r in rule_ensemble.score(df, model).collect()}
    assert all((got[i] > 0.5) == bool(q) for i, q in labels)
    assert model.weights and all(0 < s < 1 for s in got.values())


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(0)
    names = list(rule_ensemble.features())
    x = rng.random((300, len(names)))
    y = ((x[:, 1] > 0.4) & (x[:, 4] < 0.7)).astype(float)
    model = rule_ensemble.fit_rules(x, y, names)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    got = [r[0] for r in df.select(model.logit()).collect()]
    want = model.intercept + sum(w * r.holds(x, names) for r, w in model.weights)
    assert np.allclose(got, want) and np.mean((np.array(got) > 0) == y) > 0.95


# ---- language -------------------------------------------------------------


def test_language_of_held_out_texts(docs, texts):
    model = langid.fit(docs.where("doc_id % 4 <> 2"), public_tokenizers.path("piece_bpe_32k.model"), rounds=2)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    wrong = [i for i, (t, lang) in enumerate(texts) if got[i]["lang_pred"] != lang and i % 6 != 5 and i % 11 != 3 and i % 9 != 4]
    assert not wrong


def test_forward_sums_all_segmentations():
    pieces = {"<unk>": 0, "a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5}
    probs = np.array([[0.01], [0.2], [0.1], [0.3], [0.15], [0.05], [0]])

    def every(word):
        if not word:
            return 1.0
        return sum(probs[pieces.get(word[:k], 0 if k == 1 else 6), 0] * every(word[k:]) for k in range(1, len(word) + 1) if k == 1 or word[:k] in pieces)

    for word in ("a", "aba", "abab", "axb", "bbaab"):
        assert np.exp(langid.word_scores([word], pieces, probs, 3)[0, 0]) == pytest.approx(every(word))
    counts = langid.expected_counts(["aba"], np.array([[2.0]]), pieces, probs, 3)
    ways = {("a", "b", "a"): 0.2 * 0.1 * 0.2, ("ab", "a"): 0.06, ("a", "ba"): 0.03, ("aba",): 0.05}
    assert counts[3, 0] == pytest.approx(2 * 0.06 / sum(ways.values()))


def test_long_words_are_summed_like_short_ones(monkeypatch):
    rng = random.Random(4)
    pieces = {"<unk>": 0, "a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5}
    probs = np.array([[0.01, 0.02], [0.2, 0.1], [0.1, 0.3], [0.3, 0.1], [0.15, 0.2], [0.05, 0.1], [0, 0]])
    words = ["".join(rng.choice("abx") for _ in range(n)) for n in (1, 5, 20, 31, 32)]
    counts = np.array([[1.0, 2.0]] * len(words))
    short = langid.word_scores(words, pieces, probs, 3), langid.expected_counts(words, counts, pieces, probs, 3)
    monkeypatch.setattr(langid, "SHORT", 0)
    assert np.allclose(short[0], langid.word_scores(words, pieces, probs, 3))
    assert np.allclose(short[1], langid.expected_counts(words, counts, pieces, probs, 3))
    # far beyond what a double holds: a run of one letter of which every segmentation is of single letters
    assert langid.word_scores(["x" * 500], pieces, probs, 3)[0, 0] == pytest.approx(500 * np.log(0.01))


def test_letters_are_letters_by_category(spark):
    assert langid.words_of("½ ² ① Ⅷ a²b ǅo") == ["▁a", "▁b", "▁ǆo"]
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "½ ² ① Ⅷ 12", None), (4, "x" * 5000 + " the cat", None), (5, "the²cat", None)]
    docs = spark.createDataFrame(rows * 3, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))).collect()}
    assert got[3]["lang_pred"] == "und" and got[3]["score"] == 0
    assert got[5]["lang_pred"] == "en" and got[4]["lang_pred"] in ("de", "en")


# ---- language model -------------------------------------------------------


def test_base_score_and_held_out_gain(docs, texts):
    training = F.col("doc_id") % 7 != 2
    got = {r["doc_id"]: r for r in lm.score(docs, training).collect()}
    train = [t for i, (t, _) in enumerate(texts) if i % 7 != 2]
    counts = collections.Counter(w for t in train for w in words(lowered(t)))
    n, v, ends = sum(counts.values()) + len(train), len(counts) + 1, len(train)
    for i, (t, _) in enumerate(texts):
        w = words(lowered(t))
        logs = sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w) + np.log10((ends + 1) / (n + v + 1))
        assert got[i]["base_score"] == pytest.approx(logs, rel=1e-9)
        assert got[i]["n_tokens"] == len(w) + 1 and got[i]["n_known"] == sum(counts[x] > 0 for x in w) + 1 and got[i]["train_tokens"] == n
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_rare_words_come_from_the_join(docs, monkeypatch):
    want = {r["doc_id"]: r["base_score"] for r in lm.score(docs, F.lit(True)).collect()}
    monkeypatch.setattr(lm, "TOP", 20)
    got = {r["doc_id"]: r["base_score"] for r in lm.score(docs, F.lit(True)).collect()}
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_class_probabilities_and_gradient(monkeypatch):
    rng = np.random.default_rng(3)
    weights, bias = rng.normal(size=(50, lm.CLASSES)), rng.normal(size=lm.CLASSES)
    feats, classes = rng.integers(0, 50, (4, 30)), rng.integers(0, lm.CLASSES, 30)
    p = lm.class_probabilities(weights, bias, feats)
    assert np.allclose(p.sum(axis=1), 1)
    want, want_bias = np.zeros_like(weights), np.zeros_like(bias)
    for t in range(30):
        logits = np.exp(weights[feats[:, t]].sum(axis=0) + bias)
        assert np.allclose(p[t], logits / logits.sum())
        gap = logits / logits.sum() - (np.arange(lm.CLASSES) == classes[t])
        for f in feats[:, t]:
            want[f] += gap
        want_bias += gap
    touched, grad, grad_bias = lm.gradient(weights, bias, feats, classes)
    dense = np.zeros_like(want)
    dense[touched] = grad
    assert np.allclose(dense, want) and np.allclose(grad_bias, want_bias)


def test_scores_are_the_models_probabilities(docs, texts, monkeypatch):
    held = {}
    trained = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: held.setdefault("model", trained(*a)))
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, F.lit(True)).collect()}
    model = held["model"]
    lexicon, counts = model.lexicon, collections.Counter(w for t, _ in texts for w in words(lowered(t)))
    rank = {w.decode(): i for i, w in enumerate(lexicon.top)}
    in_class = collections.defaultdict(float)
    for item, c in enumerate(model.classes):
        if item < lexicon.vocabulary:
            in_class[c] += 10 ** model.token_log[item]
    assert all(v < 1 + 1e-9 for v in in_class.values())
    for i, (t, _) in list(enumerate(texts))[:25]:
        own = words(lowered(t))
        items = [rank[w] if rank.get(w, lexicon.vocabulary) < lexicon.vocabulary else lexicon.vocabulary + lm.bucket_of(w.encode()) for w in own] + [lexicon.end]
        stream, total = np.array([lexicon.end + 1] * 3 + items), 0.0
        for k, item in enumerate(items):
            feats = lm.features(stream, np.array([k + 3]), lexicon.slots)
            logits = model.weights[feats[:, 0]].sum(axis=0, dtype=np.float64) + model.bias
            p = np.exp(logits - logits.max())
            total += np.log10(p[model.classes[item]] / p.sum()) + model.token_log[item]
            if lexicon.vocabulary <= item < lexicon.end:
                total += np.log10(counts[own[k]] + 1)
        assert got[i] == pytest.approx(total, rel=1e-5)


def test_commonest_words_take_ties_in_order(spark):
    counts = spark.createDataFrame([(f"w{k:03d}", 1) for k in range(50)] + [("many", 9), ("some", 8)], "word string, c bigint")
    assert [r["word"] for r in lm.commonest(counts, 5)] == ["many", "some", "w000", "w001", "w002"]
    assert len(lm.commonest(counts, 500)) == 52 and lm.commonest(counts.where("c > 99"), 5) == []


def test_language_model_reruns_agree(docs):
    one, two = ({r["doc_id"]: (r["base_score"], r["score"]) for r in lm.score(docs, F.col("doc_id") % 7 != 2).collect()} for _ in range(2))
    assert one == two


# ---- mixing, packing, fingerprints ---------------------------------------


def brute_rates(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    """From (source, size) rows: target and dual of each source, by filling up and by bisection."""
    sizes = collections.defaultdict(list)
    for source, size in rows:
        sizes[source].append(size)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    own, weight = {s: sum(v) for s, v in sizes.items()}, {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(own.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > most * own[s]}
        target |= {s: most * own[s] for s in full} if full else {s: unit * weight[s] for s in open_}
        left -= sum(most * own[s] for s in full)
        open_ = open_ - full if full else set()
    duals = {}
    for s in order:
        if 0 < target[s] < most * own[s] - 1e-9:
            low, high, x = -50.0, 50.0, np.array([v for v in sizes[s] if v > 0], float)
            for _ in range(200):
                middle = (low + high) / 2
                low, high = (middle, high) if (x * np.minimum(most, np.exp(np.minimum(middle * x, 5.0)))).sum() < target[s] else (low, middle)
            duals[s] = low
    return target, duals


def test_mix_solves_the_dual_and_comes_near_its_targets(spark):
    rng = random.Random(12)
    rows = []
    for s, n in [("a", 40), ("b", 600), ("é", 300), ("z", 700), (None, 500), ("empty", 5)]:
        rows += [(len(rows) + k, s, " ".join(["w"] * (0 if s == "empty" else rng.choice([0, 1, 3, 8, 30, 200])))) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    target, duals = brute_rates([(s, len(words(t))) for _, s, t in rows])
    assert len(duals) >= 2 and target["a"] == pytest.approx(2 * sum(r["size"] for r in got if r["source"] == "a"))
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-9)
        if r["size"] and r["source"] in duals:
            assert r["rate"] == pytest.approx(min(2.0, np.exp(duals[r["source"]] * r["size"])), rel=1e-6)
        assert r["copies"] in ((0,) if r["size"] == 0 else (int(np.floor(r["rate"])), int(np.floor(r["rate"])) + 1)) and r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)


def test_repeats_take_what_the_mix_says(spark):
    rows = [(1, "a", "one two three", 7), (1, "a", "one two three", 7), (1, "a", "another text", 8), (None, "b", "x y", 9), (2, None, "z " * 9, 1), (3, None, "", 2), (4, "b", None, 3), (5, "b", "p q r", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, copies int")
    mixed = mixing.mix(docs)
    want = collections.Counter()
    for r in mixed.collect():
        want[(r["doc_id"], r["source"], r["text_hash"])] += r["copies"]
    got = collections.Counter((r["doc_id"], r["source"], r["h"]) for r in mixing.repeat(docs, mixed).withColumn("h", F.xxhash64("text")).collect())
    assert got == +want and mixing.repeat(docs, mixed).columns == docs.columns


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path, length=256).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
    for i, (t, _) in enumerate(texts):
        assert [x for _, ids in sorted(by_doc[i]) for x in ids] == tokenizer.encode(t, add_special_tokens=False).ids + [1]
    for s, pieces in by_sequence.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 256 or s == max(by_sequence)


def test_encoder_equals_tokenizer_on_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["", " ", "  a", "a  b\n\n c\t\td ", "it's we'LL ²½ 12,3 ñandú — “q” <|endoftext|>", "漢字 кот 🙂 \x00\x1c\x85\xa0x", "a\r\n b\x0b\x0cc", "x y　z", "​‍", "é"]
    encoder = packing.Encoder(path, public_tokenizers.PATTERN)
    assert encoder.fast is not None
    assert encoder.encode("hello <|endoftext|> world").tolist() == [31373, 220, 50256, 995]
    rng = random.Random(8)
    letters = "abcXYZ  \n\t'.,0123-éÜß—“<|>" + "endoftext"
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    odd += ["<|endoftext|>".join(odd[k : k + 3]) for k in range(0, 300, 3)]
    for text in odd:
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def brute_phrases(data):
    phrases, at = set(), 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in phrases:
            phrases.add(data[at:end])
            at = end
    return phrases


def test_parse_is_lempel_ziv():
    rng = random.Random(5)
    for _ in range(20):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 300)))
        cut = rng.randint(0, len(data))
        parse = fingerprints.Parse().feed(data[:cut])
        parse = parse.fork().feed(data[cut:])
        assert len(parse.hashes) - 1 == len(brute_phrases(data)) == len(set(parse.hashes[1:]))


def test_ranges_grow_in_number_not_in_size(spark, docs):
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    bounds, tops = fingerprints._ranges(rows, 5000)
    ids = np.array([r["id"] for r in rows.collect()])
    sizes = {r["id"]: len(r["text"].encode()) for r in rows.collect()}
    part = np.searchsorted(bounds, ids)
    assert len(bounds) >= sum(sizes.values()) // 5000
    assert max(sum(sizes[i] for i in ids[part == p]) for p in set(part)) < 3 * 5000
    assert tops == {p: ids[part == p].max() for p in set(part)}


@pytest.mark.parametrize("range_bytes", [fingerprints.RANGE_BYTES, 5000, 100])
def test_fingerprints_of_edited_and_next_texts(docs, texts, range_bytes):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_with_next(docs, range_bytes=range_bytes).collect()}
    order = sorted(range(len(texts)), reverse=True)
    exact = []
    for k, i in enumerate(order):
        t, following = texts[i][0], texts[order[(k + 1) % len(order)]][0]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert r["fingerprint"] == fingerprints.fingerprint(t) and r["edited_fingerprint"] == fingerprints.fingerprint(edited)
        a, b = brute_phrases(t.encode()), brute_phrases(edited.encode())
        exact.append(abs(len(a & b) / len(a | b) - r["near_edited"]))
    assert np.mean(exact) < 0.08
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()]) + 0.15
