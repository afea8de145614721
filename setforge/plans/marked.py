"""Registers of the ``marked`` scheme, which Arrow kernels build with a lower bound, and SQL that draws every point without one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from setforge.config import GeneralizedHyperLogLog, HyperLogLog, HyperMinHash, Registers, SetSketch1, SetSketch2
from setforge.operators import sketches
from setforge.plans.catalog import SEGMENT_ORDERS, SUPPLIER_PARTS, _value, query, segment_orders, supplier_parts

_ALL = 1 << 64
#: The public constants of splitmix64, of xxHash64 and of the Feistel rounds.
_GOLDEN, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_ROUND = 0xD1B54A32D192ED03


def _let(value: str, body: str, name: str = "v") -> str:
    """``body``, which names ``value`` as often as it likes."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _times(a: str, b: int) -> str:
    return f"(({a})::UHUGEINT * {b}::UHUGEINT % {_ALL}::UHUGEINT)::UBIGINT"


def _plus(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {_ALL}::UHUGEINT)::UBIGINT"


def _rotated(a: str, n: int) -> str:
    return _let(a, f"({_times('v', 1 << n)} + (v >> {64 - n}))::UBIGINT")


def _mixed(a: str) -> str:
    """The finalizer of splitmix64."""
    once = _let(a, _times("xor(v, v >> 30)", _MIX1))
    return _let(_let(once, _times("xor(v, v >> 27)", _MIX2)), "xor(v, v >> 31)")


def _stream(step: str, draw: int, own: str = "id") -> str:
    return _mixed(_plus(own, _times(f"2 * ({step}) + {draw + 1}", _GOLDEN)))


def _unit(h: str) -> str:
    return f"((({h}) >> 11)::DOUBLE + 0.5::DOUBLE) / {float(1 << 53)!r}::DOUBLE"


def _id(x: str) -> str:
    """xxHash64 with seed 42 of a whole number."""
    first = _let(_times(_rotated(_times(f"({x})::UBIGINT", _P2), 31), _P1), f"xor(v, {(42 + _P5 + 8) % _ALL}::UBIGINT)")
    second = _plus(_times(_rotated(first, 27), _P1), f"{_P4}")
    third = _let(_let(second, "xor(v, v >> 33)"), _times("v", _P2))
    return _let(_let(third, _times("xor(v, v >> 29)", _P3)), "xor(v, v >> 32)")


def _dealt(stratum: str, m: int) -> str:
    """The register of a stratum by four Feistel rounds; m is a power of four, so that no walk is needed."""
    half = (m.bit_length() - 1) // 2
    if 1 << 2 * half != m:
        raise ValueError("m must be a power of four")
    left, right = f"(({stratum}) >> {half})::UBIGINT", f"(({stratum}) & {(1 << half) - 1})::UBIGINT"
    state = f"{{'l': {left}, 'r': {right}}}"
    for turn in range(1, 5):
        shifted = f"({_mixed(f'xor(id, {_plus('z.r', str(turn * _ROUND % _ALL))})')} >> {64 - half})"
        state = _let(state, f"{{'l': z.r, 'r': xor(z.l, {shifted})}}", "z")
    return _let(state, f"(z.l * {1 << half} + z.r)::INT", "z")


def marked_sql(source: str, cfg) -> str:
    """(key, reg, k) of every point of every element; registers are their maxima, whatever a kernel left out."""
    ids = f"ids AS (SELECT DISTINCT key, {_id('x')} AS id FROM ({source}))"
    if isinstance(cfg, SetSketch2):
        draws = f"SELECT key, {_dealt('s::UBIGINT', cfg.m)} AS reg, {_value(f'(-ln(1 - (s + {_unit(_stream("s", 0))}) / {float(cfg.m)!r}::DOUBLE) / {cfg.a!r}::DOUBLE)', cfg.b, cfg.q)} AS k FROM ids, range({cfg.m}) t(s)"
        return f"WITH {ids} SELECT key, reg, max(k) AS k FROM ({draws}) WHERE k > 0 GROUP BY key, reg"
    if isinstance(cfg, SetSketch1):
        rate = f"{cfg.a * cfg.m!r}::DOUBLE"
        walk = f"walk AS (SELECT key, id, 0 AS step, -ln(1 - {_unit(_stream('0', 0))}) / {rate} AS x FROM ids UNION ALL SELECT key, id, step + 1, x - ln(1 - {_unit(_stream('step + 1', 0))}) / {rate} FROM walk WHERE x <= 1)"
        return f"WITH RECURSIVE {ids}, {walk} SELECT key, reg, max(k) AS k FROM (SELECT key, ({_stream('step', 1)} % {cfg.m})::INT AS reg, {_value('x', cfg.b, cfg.q)} AS k FROM walk WHERE x <= 1) WHERE k > 0 GROUP BY key, reg"
    h, other = _stream("0", 0), _stream("0", 1)
    ones = "bit_count(xor(h, h + 1))::INT"
    if isinstance(cfg, HyperLogLog):
        reg, k = f"(h >> {64 - cfg.p})::INT", f"least({ones}, {cfg.q + 1})"
    elif isinstance(cfg, HyperMinHash):
        reg, k = f"(other >> {64 - cfg.bucket_bits})::INT", f"(least({ones}, {1 << cfg.bucket_size}) * {1 << cfg.sub_bits} + (other & {(1 << cfg.sub_bits) - 1}))::INT"
    else:
        reg, k = f"(other % {cfg.m})::INT", _value(_unit("h"), cfg.b, cfg.q)
    return f"WITH {ids} SELECT key, reg, max(k) AS k FROM (SELECT key, {reg} AS reg, {k} AS k FROM (SELECT key, {h} AS h, {other} AS other FROM ids)) WHERE k > 0 GROUP BY key, reg"


MARKED = {
    "hll": HyperLogLog(256, 2.0, 56, scheme="marked"), "ghll": GeneralizedHyperLogLog(200, 1.2, 254, scheme="marked"), "hyperminhash": HyperMinHash(8, 6, 10, scheme="marked"),
    "setsketch1": SetSketch1(16, 1.2, 254, 2.0, scheme="marked"), "setsketch2": SetSketch2(16, 2.0, 62, 20.0, scheme="marked"),
}


def _built(cfg: Registers | HyperMinHash, wide: bool):
    def call(spark: SparkSession, sf: str) -> DataFrame:
        return sketches.build(cfg, (supplier_parts if wide else segment_orders)(spark, sf), "x", ["key"])

    return call


for _name, _cfg in MARKED.items():
    # one update an element: many keys; many updates: few keys
    _wide = not isinstance(_cfg, (SetSketch1, SetSketch2))
    query(f"marked_{_name}_registers", marked_sql(SUPPLIER_PARTS if _wide else SEGMENT_ORDERS, _cfg))(_built(_cfg, _wide))
