"""Queries on bit streams that run over several hashes, with SQL that writes a stream as a text of binary digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.functions import bitstream
from setforge.plans.catalog import _hex, query, table

X = "o_orderkey"


def digits_sql(words: int) -> str:
    """(o_orderkey, digits): the first words of each order's stream."""
    texts = [f"lpad(bin({_hex(f"o_orderkey::VARCHAR || '|{w}'", 1, 15)}), {bitstream.WORD}, '0')" for w in range(words)]
    return f"SELECT o_orderkey, {' || '.join(texts)} AS digits FROM orders"


@query(
    "bit_reads",
    f"""SELECT n::INT AS bits, count(*) AS reads, sum((('0b' || substr(digits, o_orderkey % 60 + 1, n))::UBIGINT % 1009)::BIGINT)::BIGINT AS checksum,
sum((substr(digits, o_orderkey % 60 + n, 1) = '1')::BIGINT)::BIGINT AS last_bits FROM ({digits_sql(3)}), range(1, 65) t(n) GROUP BY n""",
)
def bit_reads(spark: SparkSession, sf: str) -> DataFrame:
    """1 to 64 bits from every place of a word, read at once; and the last of them alone."""
    wanted = table(spark, sf, "orders").select(X, F.pmod(F.col(X), F.lit(60)).cast("int").alias("at"), F.explode(F.sequence(F.lit(1), F.lit(64))).alias("bits"))
    at, n = F.col("at"), F.col("bits")
    rows = wanted.select("bits", bitstream.read("md5", F.col(X), at, n).alias("v"), bitstream.bit("md5", F.col(X), at + n - 1).alias("last"))
    # a value of 64 bits counts as unsigned
    rest = F.pmod(F.pmod(F.shiftrightunsigned("v", 1), F.lit(1009)) * 2 + F.col("v").bitwiseAND(F.lit(1)), F.lit(1009))
    return rows.groupBy("bits").agg(F.count(F.lit(1)).alias("reads"), F.sum(rest).alias("checksum"), F.sum("last").alias("last_bits"))


_NS = (1, 2, 3, 6, 7, 100, 1000, 1_000_003, 1 << 31)
#: Where in the stream the draws begin, so that some run over the end of a word.
_AT = 47


def by_halves_sql(n: int) -> str:
    first = max(1, (n - 1).bit_length())
    start = f"('0b' || substr(digits, {_AT + 1}, {first}))::BIGINT"
    return f"""SELECT o_orderkey, {n}::BIGINT AS n, c AS drawn FROM (
WITH RECURSIVE s AS (SELECT o_orderkey, digits, {start} AS c, {1 << first}::BIGINT AS v, 0 AS step FROM ({digits_sql(5)})
UNION ALL SELECT o_orderkey, digits, 2 * (c - CASE WHEN v >= {n} THEN {n} ELSE 0 END) + substr(digits, {_AT + first + 1} + step, 1)::BIGINT, 2 * (v - CASE WHEN v >= {n} THEN {n} ELSE 0 END), step + 1 FROM s WHERE v < {n} OR c >= {n})
SELECT o_orderkey, c FROM s WHERE v >= {n} AND c < {n})"""


def by_product_sql(n: int) -> str:
    draws = f"SELECT o_orderkey, i, ('0b' || substr(digits, {_AT + 1} + 32 * i, 32))::BIGINT * {n} AS m FROM ({digits_sql(7)}), range(11) t(i)"
    return f"SELECT o_orderkey, {n}::BIGINT AS n, arg_min(m >> 32, i) AS drawn FROM ({draws}) WHERE m & 4294967295 >= {(1 << 32) % n} GROUP BY o_orderkey"


for _name, _sql, _draw in (("halves", by_halves_sql, bitstream.uniform_by_halves), ("product", by_product_sql, bitstream.uniform_by_product)):
    _ns = _NS if _name == "product" else _NS[1:]
    query(f"uniform_int_by_{_name}", " UNION ALL ".join(map(_sql, _ns)))(
        lambda s, d, draw=_draw, ns=_ns: table(s, d, "orders").select("o_orderkey", F.explode(F.array(*(F.struct(F.lit(n).cast("bigint").alias("n"), draw("md5", F.col(X), _AT, n).alias("drawn")) for n in ns))).alias("r")).select("o_orderkey", "r.*")
    )
