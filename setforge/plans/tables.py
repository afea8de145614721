"""Queries that write results by configuration, wide as joint result files are, and read one configuration back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.config import MinHash
from setforge.operators import joint, sketches
from setforge.plans.catalog import compared_sql, key_pairs, minhash_sql, query, table
from setforge.plans.more import _CLIP, _R
from setforge.sources import results
from setforge.sources.stored import new_folder, stored

EXAMPLES = 2
MINHASHES = [MinHash(m, scheme="md5") for m in (32, 64)]
LABELS = ["inclExcl", "new", "original", "simpleDeprecated", "inclExclKnownCard", "newKnownCard", "originalKnownCard"]


def true_joint(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(distinct (key, x), sizes (key, estimate), wanted (k1, k2), truth (k1, k2, q)) of the few keys in ``elements`` (key, x), stored."""
    keys = ["k1", "k2"]
    distinct = stored(elements.select("key", "x").distinct(), "joint-elements")
    sizes = stored(distinct.groupBy("key").agg(F.count("x").cast("double").alias("estimate")), "joint-sizes")
    wanted = key_pairs(sizes)
    # what both sets hold, from the elements themselves
    both = distinct.select(F.col("key").alias("k1"), "x").join(distinct.select(F.col("key").alias("k2"), "x"), "x").where("k1 < k2").groupBy(*keys).agg(F.count(F.lit(1)).alias("both"))
    sized = wanted.join(both, keys, "left").join(sizes.select(F.col("key").alias("k1"), F.col("estimate").alias("n1")), "k1").join(sizes.select(F.col("key").alias("k2"), F.col("estimate").alias("n2")), "k2")
    i = F.coalesce("both", F.lit(0)).cast("double")
    truth = stored(sized.select(*keys, joint.derived(F.col("n1") - i, F.col("n2") - i, i).alias("q")), "joint-truth")
    return distinct, sizes, wanted, truth


def joint_results(cfg: MinHash, elements: DataFrame, examples: int, true: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(k1, k2, joint schema) of all pairs of the few keys in ``elements`` (key, x); an example salts the elements.  ``true`` is their ``true_joint``, where it is known."""
    keys = ["k1", "k2"]
    distinct, sizes, wanted, truth = true or true_joint(elements)
    of = lambda c: F.concat_ws("~", c, "example")
    each_example = F.explode(F.sequence(F.lit(0), F.lit(examples - 1)))
    salted = distinct.withColumn("example", each_example)
    # m rows a set, read by every estimator
    regs = stored(sketches.build(cfg, salted.select(of("key").alias("key"), of("x").alias("x")), "x", ["key"]), "joint-registers")
    each = wanted.withColumn("example", each_example).select(of("k1").alias("k1"), of("k2").alias("k2"))
    known = sizes.withColumn("example", each_example).select(of("key").alias("key"), "estimate")
    plain = [F.substring_index(k, "~", 1).alias(k) for k in keys]
    found = stored(joint.joint(cfg, regs, "key", each, known).select(*plain, "estimator", "q"), "joint-found")
    share = F.col("d_equal") / float(cfg.m)
    bounds = joint.pairs(cfg, regs, "key", each).select(*plain, share.alias("lower"), share.alias("upper"))
    return results.joint_schema(found, truth, keys, LABELS, bounds)


def joint_results_sql(cfg: MinHash) -> str:
    source = f"SELECT o_orderpriority || '~' || e AS key, o_custkey || '~' || e AS x FROM orders, range({EXAMPLES}) t(e)"
    forms = {
        "inclExcl": "(n1 + n2 - nu) / nu", "original": f"d_equal / {cfg.m}::DOUBLE", "simpleDeprecated": f"greatest(0, 1 - d_minus / {cfg.m}::DOUBLE - d_plus / {cfg.m}::DOUBLE)",
        "new": f"greatest(0, (n1 * n1 * (d_equal + d_plus) + n2 * n2 * (d_equal + d_minus) - sqrt(pow(n1 * n1 * (d_equal + d_plus) - n2 * n2 * (d_equal + d_minus), 2) + 4.0 * d_plus * d_minus * n1 * n1 * n2 * n2)) / (2.0 * {cfg.m} * n1 * n2))",
    }
    each = " UNION ALL ".join(f"SELECT k1, k2, '{label}' AS label, n1, n2, {_CLIP.format(forms[label.removesuffix('KnownCard')])} AS j FROM cards WHERE suffix = '{'KnownCard' if label.endswith('KnownCard') else ''}'" for label in LABELS)
    quantity = {
        "Difference1": "d1", "Difference2": "d2", "Intersection": "i", "1": "d1 + i", "2": "d2 + i", "Union": "d1 + d2 + i", "Jaccard": "i / (d1 + d2 + i)", "Cosine": "i / sqrt((d1 + i) * (d2 + i))",
        "InclusionCoefficient1": "i / (d1 + i)", "InclusionCoefficient2": "i / (d2 + i)", "Alpha": "d1 / (d1 + d2 + i)", "Beta": "d2 / (d1 + d2 + i)",
    }
    values = ", ".join(f'{q} AS "q{n}"' for n, q in quantity.items())
    own = ", ".join(f"""round(avg("q{n}") FILTER (label = '{label}'), 6) AS "{label}Mean{n}", round(avg(pow("q{n}" - "t{n}", 2)) FILTER (label = '{label}'), 5) AS "{label}MSE{n}\"""" for label in LABELS for n in quantity)
    true = ", ".join(f'round(any_value("t{n}"), 6) AS "true{n}"' for n in quantity)
    return f"""WITH {compared_sql(cfg, minhash_sql(_R).replace(f"{64}::DOUBLE / sum", f"{cfg.m}::DOUBLE / sum"), source)},
kc AS (SELECT o_orderpriority AS key, count(DISTINCT o_custkey)::DOUBLE AS n FROM orders GROUP BY 1),
merged AS (SELECT a.key || '#' || b.key AS key, a.reg, least(a.k, b.k) AS k FROM full_regs a JOIN full_regs b ON a.reg = b.reg AND a.key < b.key), un AS ({minhash_sql('SELECT * FROM merged').replace(f"{64}::DOUBLE / sum", f"{cfg.m}::DOUBLE / sum")}),
one AS (SELECT p.* REPLACE (split_part(k1, '~', 1) AS k1, split_part(k2, '~', 1) AS k2), un.estimate AS nu FROM p JOIN un ON un.key = k1 || '#' || k2 WHERE split_part(k1, '~', 2) = split_part(k2, '~', 2)),
cards AS (SELECT '' AS suffix, * FROM one UNION ALL SELECT 'KnownCard', one.* REPLACE (a.n AS n1, b.n AS n2) FROM one JOIN kc a ON a.key = k1 JOIN kc b ON b.key = k2),
js AS ({each}), ds AS (SELECT k1, k2, label, greatest(0, n1 - n2 * j) / (1 + j) AS d1, greatest(0, n2 - n1 * j) / (1 + j) AS d2, (n1 + n2) * j / (1 + j) AS i FROM js),
qs AS (SELECT k1, k2, label, {values} FROM ds),
sets AS (SELECT DISTINCT o_orderpriority AS key, o_custkey AS x FROM orders), inter AS (SELECT a.key AS k1, b.key AS k2, count(*)::DOUBLE AS i FROM sets a JOIN sets b ON a.x = b.x AND a.key < b.key GROUP BY 1, 2),
tr AS (SELECT k1, k2, {', '.join(f'{q} AS "t{n}"' for n, q in quantity.items())} FROM (SELECT k1, k2, i, a.n - i AS d1, b.n - i AS d2 FROM inter JOIN kc a ON a.key = k1 JOIN kc b ON b.key = k2)),
coll AS (SELECT k1, k2, round(avg(d_equal / {cfg.m}::DOUBLE), 6) AS mean, round(avg(pow(d_equal / {cfg.m}::DOUBLE - "tJaccard", 2)), 5) AS mse FROM one JOIN tr USING (k1, k2) GROUP BY k1, k2)
SELECT '{cfg.m}' AS m, x.*, coll.mean AS "collLowerBoundMeanJaccard", coll.mean AS "collUpperBoundMeanJaccard", coll.mse AS "collLowerBoundMSEJaccard", coll.mse AS "collUpperBoundMSEJaccard"
FROM (SELECT k1, k2, {true}, {own} FROM qs JOIN tr USING (k1, k2) GROUP BY k1, k2) x JOIN coll USING (k1, k2)"""


@query("joint_result_files", joint_results_sql(MINHASHES[1]))
def joint_result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Joint results of two configurations written, and those of one read again."""
    elements = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("x"))
    folder, true = new_folder(spark, "joint-results"), true_joint(elements)
    for cfg in MINHASHES:
        results.write_partitioned(joint_results(cfg, elements, EXAMPLES, true), folder, {k: cfg.info()[k] for k in ("name", "m", "scheme")})
    columns = results.joint_columns(LABELS)
    schema = ", ".join(["k1 string", "k2 string", *(f"`{c}` double" for c in columns)])
    found = results.read_partitioned(spark, folder, schema, ["name", "m", "scheme"]).where("name = 'MinHash' AND m = '64'")
    return found.select("m", "k1", "k2", *(F.round(F.col(f"`{c}`"), 5 if "MSE" in c else 6).alias(c) for c in columns))
