"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.llm.shared import crc_bucket, read_table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from setforge.llm.langid import fit, predict

    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 4) == 2
    model = fit(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setforge.llm.pii import pii_digest

    return pii_digest(read_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setforge.llm.substring_dedup import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setforge.llm.lm import score

    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 7) == 2
    return score(docs, ~held_out).withColumn("held_out", held_out)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setforge.llm.mixing import mix

    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setforge.llm.quality_rules import quality_rules

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    judged, at = quality_rules(docs, with_text=False)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(at[n]).alias(n) for n in names))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setforge.llm.fingerprints import fingerprint_with_next

    return fingerprint_with_next(read_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setforge.llm.near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4, percent=80)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from setforge.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setforge.llm.rule_ensemble import fit, score

    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 4) == 2
    model = fit(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setforge.llm.resample import resample

    docs, target = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark")
    drawn, at = resample(docs, target, with_text=False)
    return drawn.select("doc_id", *(F.col(at[n]).alias(n) for n in ("n_features", "weight", "score", "rank")))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setforge.llm.licenses import scan_licenses

    scanned, at = scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return scanned.select("doc_id", *(F.col(at[n]).alias(n) for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setforge.llm.fill_in_middle import fill_in_middle

    made, at = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_output=False, with_digests=True)
    return made.select("doc_id", *(F.col(at[n]).alias(n) for n in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_pii": op2_pii,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_lm": op4_lm,
    "op5_mixing": op5_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_resample": op11_resample,
    "op12_licenses": op12_licenses,
    "op13_fill_in_middle": op13_fill_in_middle,
}

OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), win AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 9)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) t(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), r AS (
  SELECT source, unnest(['few_words', 'repeats', 'symbols', 'lines']) AS rule,
         unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > word_chars, 10 * n_dup_lines > n_words])::INT AS failed FROM b
), h AS (
  SELECT source, rule, count(*) AS n, sum(failed) AS f, sum(failed) / count(*) AS rate FROM r GROUP BY source, rule
), p AS (
  SELECT rule, avg(rate) AS mean, CASE WHEN var_pop(rate) > 0
         THEN greatest(1.0, least(1000.0, avg(rate) * (1 - avg(rate)) / var_pop(rate) - 1)) ELSE 1000.0 END AS s FROM h GROUP BY rule
), v AS (
  SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (n + s + 1)) > 0.25) AS bad
  FROM (SELECT source, n, s, (f + mean * s) / (n + s) AS rate FROM h JOIN p USING (rule)) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT bad AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), e2 AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e2.b FROM r JOIN e2 ON e2.a = r.reach
), m AS (
  SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# crc32: eight halvings for each byte, as a table of 256 values and one step a byte
OP11_SQL = rf"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)::BIGINT[]), lambda c, _: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)
), w AS (
  SELECT doc_id, {_PLAIN_WORDS} AS words FROM documents
), dw AS (
  SELECT doc_id, unnest(words) AS word FROM w
), bw AS (
  SELECT unnest({_PLAIN_WORDS}) AS word FROM benchmark
), b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i::INT + 1, 2))::BIGINT)),
         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), tab
), s AS (
  SELECT bucket, count(*) AS n FROM dw JOIN b USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM bw JOIN b USING (word) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (SELECT count(*) + 10000 FROM dw)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (SELECT count(*) + 10000 FROM bw)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), d AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id
), x AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN d USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS i, count(*) OVER () AS n FROM x WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN i <= 10 * n // 100 THEN i END AS rank FROM x LEFT JOIN r USING (doc_id)
"""


def _op12_sql() -> str:
    """Index, rarity, proposed starts and mandatory phrases as joins."""
    from setforge.llm.licenses import BASE, RARE, Scanner

    scanner = Scanner()
    postings = ", ".join(f"({t}, '{w.decode()}', {q})" for t, one in enumerate(scanner.templates) for w, qs in one.places.items() for q in qs)
    phrases = ", ".join(f"({t}, '{b' '.join(p).decode()}', {len(p)}, {q})" for t, one in enumerate(scanner.templates) for p, q in one.phrases)
    templates = ", ".join(f"({t}, '{one.label}', {one.slack}, {min(RARE, len(one.places))}, {len(one.phrases)})" for t, one in enumerate(scanner.templates))
    base = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in BASE)
    known = ", ".join(f"('{w.decode()}')" for w in scanner.words)
    return rf"""
WITH posting(t, word, q) AS (VALUES {postings}), phrase(t, phrase, size, q) AS (VALUES {phrases}), template(t, label, slack, whole, needed) AS (VALUES {templates}),
base(phrase, size, label) AS (VALUES {base}), known(word) AS (VALUES {known}),
w AS (SELECT doc_id, {_PLAIN_WORDS} AS words FROM documents),
h AS (SELECT doc_id, p - 1 AS p, words[p] AS word, words FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w) WHERE words[p] IN (SELECT word FROM known)),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM h GROUP BY word),
b AS (SELECT doc_id, p, label FROM h JOIN base ON array_to_string(words[p + 1 : p + size], ' ') = phrase),
bd AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS held FROM b GROUP BY doc_id),
f AS (SELECT DISTINCT doc_id, t, phrase, p - q AS o FROM h JOIN phrase ON array_to_string(words[p + 1 : p + size], ' ') = phrase),
whole AS (SELECT doc_id, t FROM f JOIN template USING (t) GROUP BY doc_id, t, needed HAVING count(DISTINCT phrase) = needed),
rare AS (SELECT doc_id, t, word FROM (SELECT doc_id, t, word, row_number() OVER (PARTITION BY doc_id, t ORDER BY n, word) AS i
  FROM (SELECT DISTINCT doc_id, t, word FROM whole JOIN h USING (doc_id) JOIN posting USING (t, word)) JOIN df USING (word)) WHERE i <= {RARE}),
o AS (SELECT DISTINCT doc_id, t, word, p - q AS o FROM rare JOIN h USING (doc_id, word) JOIN posting USING (t, word)),
band AS (SELECT doc_id, t, o FROM o UNION SELECT doc_id, t, o FROM f JOIN whole USING (doc_id, t)),
vote AS (SELECT band.doc_id, t, band.o, count(DISTINCT word) AS votes FROM band JOIN template USING (t) JOIN o USING (doc_id, t) WHERE o.o BETWEEN band.o AND band.o + slack GROUP BY ALL),
held AS (SELECT band.doc_id, t, band.o, count(DISTINCT phrase) AS n FROM band JOIN template USING (t) JOIN f USING (doc_id, t) WHERE f.o BETWEEN band.o AND band.o + slack GROUP BY ALL),
m AS (SELECT doc_id, label, votes / whole::DOUBLE AS share FROM vote JOIN held USING (doc_id, t, o) JOIN template USING (t) WHERE n = needed AND 2 * votes >= whole),
md AS (SELECT doc_id, max(share) AS score, list(DISTINCT label) AS held FROM m GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(bd.held), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bd.held, []), coalesce(md.held, [])))), ',') AS labels,
       greatest(coalesce(score, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM w LEFT JOIN bd USING (doc_id) LEFT JOIN md USING (doc_id)
"""


OP13_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || doc_id) AS h FROM documents
), k AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u
), c AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1 : least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix, array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1 : greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
         array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 :], '') AS suffix FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM c
"""

ORACLE_SQL: dict[str, str] = {"op7_near_dedup": OP7_SQL, "op8_quality_rules": OP8_SQL, "op11_resample": OP11_SQL, "op12_licenses": _op12_sql(), "op13_fill_in_middle": OP13_SQL}
