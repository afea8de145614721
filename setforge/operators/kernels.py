"""Arrow kernels: registers held in numpy while a task reads its rows.

A task keeps one register block a key and sends each block once it ends (or once
``MAX_KEYS`` keys are held), so its shuffle is at most keys x registers rows.
MinHash registers equal themselves under any order.  The other families use the
``marked`` scheme here: an element's points are drawn in ascending order from a
counter-based stream, and drawing stops as soon as no register can rise, so that a
filled sketch looks at one hash an element:

* HyperLogLog, GHLL, HyperMinHash: one point, compared with the lowest register
  before its value is computed;
* SetSketch1: a Poisson process whose points land in random registers;
* SetSketch2: one point in each of m strata of equal mass, dealt to registers by a
  permutation that a keyed Feistel network gives.

A fixed ``limit`` in the place of the lowest register is bulk insertion.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from setforge.config import GeneralizedHyperLogLog, HyperLogLog, HyperMinHash, MinHash, Registers, SetSketch1, SetSketch2, SketchFamily
from setforge.operators import families

MAX_KEYS = 512
#: Rows a key that a batch must have for blocks to be worth holding, where elements have one point.
ROWS_A_KEY = 32
#: Elements that are inserted together where there is one key.
CHUNK = 1 << 15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public domain constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(ids: np.ndarray, step: int, draw: int) -> np.ndarray:
    """Counter-based 64-bit values: one for each id, step and draw."""
    return _mix(ids + np.uint64(((2 * step + draw + 1) * 0x9E3779B97F4A7C15) & _MASK))


def _unit(h: np.ndarray) -> np.ndarray:
    """In (0, 1), from the upper 53 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _bound(share: float) -> np.uint64:
    """Hashes above this give a ``_unit`` above ``share``."""
    return np.uint64(min(1 << 53, math.ceil(min(max(share, 0.0), 1.0) * (1 << 53)) + 1) * (1 << 11) - 1)


def _trailing_ones(h: np.ndarray) -> np.ndarray:
    lowest_zero = ~h & (h + np.uint64(1))
    found = (lowest_zero.astype(np.float64).view(np.int64) >> 52) - 1023
    found[lowest_zero == 0] = 64
    return found


class MaxRegisters:
    """Registers that only rise, with a bound below which nothing matters; ``add`` takes 64-bit ids."""

    def __init__(self, cfg: SketchFamily, limit: float | None = None):
        self.cfg, self.limit, self.k = cfg, limit, np.zeros(cfg.m, np.int32)
        self.changes, self.lowest = 0, 0

    def raised(self, reg: np.ndarray, k: np.ndarray) -> None:
        np.maximum.at(self.k, reg, k.astype(np.int32))
        self.changes += len(reg)
        if self.changes >= self.cfg.m and self.limit is None:  # refresh the bound now and then
            self.lowest, self.changes = int(self.k.min()), 0

    def largest(self) -> float:
        """Points above this are not needed; those above 1 give a register 0."""
        return self.cfg.b ** -float(self.lowest) if self.limit is None else min(1.0, self.limit)

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(1 - np.log(x) / self.cfg.log_b), 0, self.cfg.q + 1).astype(np.int32)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        reg = np.flatnonzero(self.k)
        return reg.astype(np.int32), self.k[reg].astype(np.int64)


class OnePoint(MaxRegisters):
    """Families in which an element has one point: ``points`` gives (register, value) of each id, whatever its key."""

    def points(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError


class HllRegisters(OnePoint):
    def points(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, cfg = stream(ids, 0, 0), self.cfg
        return (h >> np.uint64(64 - cfg.p)).astype(np.int64) if cfg.p else np.zeros(len(h), np.int64), np.minimum(_trailing_ones(h) + 1, cfg.q + 1)

    def add(self, ids: np.ndarray) -> None:
        h, cfg = stream(ids, 0, 0), self.cfg
        low = np.uint64((1 << min(self.lowest, cfg.q)) - 1)
        h = h[(h & low) == low]
        if self.lowest <= cfg.q:
            self.raised((h >> np.uint64(64 - cfg.p)).astype(np.int64) if cfg.p else np.zeros(len(h), np.int64), np.minimum(_trailing_ones(h) + 1, cfg.q + 1))


class GhllRegisters(OnePoint):
    def points(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (stream(ids, 0, 1) % np.uint64(self.cfg.m)).astype(np.int64), self.values(_unit(stream(ids, 0, 0)))

    def add(self, ids: np.ndarray) -> None:
        h = stream(ids, 0, 0)
        live = h <= _bound(self.largest())
        self.raised((stream(ids[live], 0, 1) % np.uint64(self.cfg.m)).astype(np.int64), self.values(_unit(h[live])))


class HyperMinRegisters(OnePoint):
    def points(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, other, cfg = stream(ids, 0, 0), stream(ids, 0, 1), self.cfg
        value, rest = np.minimum(_trailing_ones(h) + 1, 1 << cfg.bucket_size), (other & np.uint64((1 << cfg.sub_bits) - 1)).astype(np.int64)
        return (other >> np.uint64(64 - cfg.bucket_bits)).astype(np.int64), value << cfg.sub_bits | rest

    def add(self, ids: np.ndarray) -> None:
        h, cfg, top = stream(ids, 0, 0), self.cfg, 1 << self.cfg.bucket_size
        low = np.uint64((1 << max(0, (self.lowest >> cfg.sub_bits) - 1)) - 1)
        live = (h & low) == low
        value, other = np.minimum(_trailing_ones(h[live]) + 1, top), stream(ids[live], 0, 1)
        rest = (other & np.uint64((1 << cfg.sub_bits) - 1)).astype(np.int64)
        self.raised((other >> np.uint64(64 - cfg.bucket_bits)).astype(np.int64), value << cfg.sub_bits | rest)


class SetSketch1Registers(MaxRegisters):
    def add(self, ids: np.ndarray) -> None:
        rate, m = self.cfg.a * self.cfg.m, np.uint64(self.cfg.m)
        h = stream(ids, 0, 0)
        live = h <= _bound(-math.expm1(-rate * self.largest()))
        ids, x, step = ids[live], -np.log1p(-_unit(h[live])) / rate, 0
        while len(ids):
            live = x <= self.largest()
            ids, x = ids[live], x[live]
            self.raised((stream(ids, step, 1) % m).astype(np.int64), self.values(x))
            step += 1
            x = x - np.log1p(-_unit(stream(ids, step, 0))) / rate


class SetSketch2Registers(MaxRegisters):
    def __init__(self, cfg: SetSketch2, limit: float | None = None):
        super().__init__(cfg, limit)
        self.half = max(1, (max(cfg.m - 1, 1).bit_length() + 1) // 2)

    def dealt(self, ids: np.ndarray, stratum: int) -> np.ndarray:
        """The register of each element's stratum: a permutation of 0 .. m-1 by element."""
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        out, open_ = np.full(len(ids), stratum, np.uint64), np.arange(len(ids))
        while len(open_):  # walk on where the network leaves 0 .. m-1
            left, right, own = out[open_] >> half, out[open_] & mask, ids[open_]
            for turn in range(4):
                left, right = right, left ^ _mix(own ^ (right + np.uint64((turn + 1) * 0xD1B54A32D192ED03 & _MASK))) >> np.uint64(64 - self.half)
            out[open_] = left << half | right
            open_ = open_[out[open_] >= np.uint64(self.cfg.m)]
        return out.astype(np.int64)

    def add(self, ids: np.ndarray) -> None:
        a, m, stratum = self.cfg.a, self.cfg.m, 0
        while len(ids) and stratum < m:
            h = stream(ids, stratum, 0)
            live = h <= _bound(-math.expm1(-a * self.largest()) * m - stratum)
            ids, h = ids[live], h[live]
            self.raised(self.dealt(ids, stratum), self.values(-np.log1p(-(stratum + _unit(h)) / m) / a))
            stratum += 1


class MinRegisters:
    """MinHash registers of 60 bits; blocks of hashes stay inside a core's cache."""

    BLOCK = 1 << 16

    def __init__(self, cfg: MinHash):
        self.cfg, self.k = cfg, np.full(cfg.m, cfg.span, np.int64)
        self.salt = (_mix(np.arange(1, cfg.m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))

    def add(self, ids: np.ndarray) -> None:
        ids = _mix(ids)
        step = max(1, self.BLOCK // self.cfg.m)
        x, y = (np.empty((step, self.cfg.m), np.uint64) for _ in range(2))
        for lo in range(0, len(ids), step):
            part = ids[lo : lo + step]
            x, y = x[: len(part)], y[: len(part)]
            np.multiply(part[:, None], self.salt, out=x)
            np.right_shift(x, np.uint64(32), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint64(0xD6E8FEB86659FD93), out=x)
            np.minimum(self.k, (x.min(axis=0) >> np.uint64(4)).astype(np.int64), out=self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        reg = np.flatnonzero(self.k < self.cfg.span)
        return reg.astype(np.int32), self.k[reg]


for _kind, _block in ((SetSketch1, SetSketch1Registers), (SetSketch2, SetSketch2Registers), (HyperLogLog, HllRegisters), (GeneralizedHyperLogLog, GhllRegisters), (HyperMinHash, HyperMinRegisters)):
    families.kernel.register(_kind, lambda cfg, limit=None, make=_block: make(cfg, limit))
families.kernel.register(MinHash, lambda cfg, limit=None: MinRegisters(cfg))


def block(cfg: SketchFamily, limit: float | None = None) -> MaxRegisters | MinRegisters:
    """A family's register block; a function of this module, so that workers that unpickle it know the families above."""
    return families.kernel(cfg, limit)


@families.by_kernel.register(Registers)
@families.by_kernel.register(HyperMinHash)
def _marked(cfg) -> bool:
    return cfg.scheme == "marked"


@families.by_kernel.register(SetSketch1)
@families.by_kernel.register(MinHash)
def _marked_or_wide(cfg) -> bool:
    return cfg.scheme == "marked" or cfg.m >= 1024 and cfg.scheme == "xxhash64"


def element_id(df: DataFrame, element: str) -> Column:
    """A 64-bit id; whole numbers of any type have the same, others go by their text."""
    whole = isinstance(df.schema[element].dataType, IntegralType)
    return F.xxhash64(F.col(element).cast("bigint" if whole else "string"))


def _held_blocks(cfg: SketchFamily, rows: DataFrame, kept: list[str], schema: StructType, limited: bool, sent, loose=None) -> DataFrame:
    """mapInArrow over (kept..., id): a register block a key, which ``sent(key, block, types)`` turns into a batch when it leaves.

    At most ``MAX_KEYS`` blocks are held; one more key sends the one whose key came first.  A batch with so many
    keys that blocks would come and go with hardly a row goes to ``loose(batch)`` as a whole, where that is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, MaxRegisters | MinRegisters] = {}
        types: list[pa.DataType] = []
        waiting: list[np.ndarray] = []

        def of(key: tuple) -> MaxRegisters | MinRegisters:
            if key not in held:
                held[key] = block(cfg, key[-1] if limited else None)
            return held[key]

        for batch in batches:
            types = [c.type for c in batch.columns[:-1]]
            ids = batch.column(len(kept)).to_numpy().view(np.uint64)
            if not kept:
                waiting.append(ids)
                if sum(map(len, waiting)) >= CHUNK:
                    of(()).add(np.concatenate(waiting))
                    waiting = []
                continue
            # number the keys by their columns' dictionaries, so that only distinct keys become Python objects
            own = np.zeros(batch.num_rows, np.int64)
            for column in batch.columns[:-1]:
                code = column.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
                own = np.unique(own * (int(code.max()) + 1) + code, return_inverse=True)[1]
            if loose and batch.num_rows < ROWS_A_KEY * (int(own.max(initial=-1)) + 1):
                yield loose(batch)
                continue
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(int(own.max()) + 2))
            firsts = batch.take(pa.array(order[cuts[:-1]]))
            for i, key in enumerate(zip(*(c.to_pylist() for c in firsts.columns[:-1]))):
                if key not in held and len(held) >= MAX_KEYS:
                    first = next(iter(held))
                    yield from sent(first, held.pop(first), types)
                of(key).add(ids[order[cuts[i] : cuts[i + 1]]])
        if waiting:
            of(()).add(np.concatenate(waiting))
        for key, registers in held.items():
            yield from sent(key, registers, types)

    return rows.mapInArrow(run, schema)


def partial_registers(cfg: SketchFamily, df: DataFrame, element: str, keys: list[str], limit: str | None = None) -> DataFrame:
    """(keys..., reg, k) with a row for each key, register and task at most, or an element where keys are many; ``limit`` names a column, constant by key, above which points are left out."""
    one_point = isinstance(block(cfg), OnePoint) and not limit
    kept = [*keys, limit] if limit else keys
    rows = df.where(F.col(element).isNotNull()).select(*kept, element_id(df, element).alias("__id"))
    schema = StructType(list(rows.select(*kept).schema.fields)).add("reg", "integer").add("k", "long" if isinstance(cfg, MinHash) else "integer")

    def sent(key: tuple, registers: MaxRegisters | MinRegisters, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        reg, k = registers.rows()
        if len(reg):
            named = [pa.array([v] * len(reg), t) for v, t in zip(key, types)]
            yield pa.RecordBatch.from_arrays([*named, pa.array(reg), pa.array(k if isinstance(cfg, MinHash) else k.astype(np.int32))], names=[*kept, "reg", "k"])

    def loose(batch: pa.RecordBatch) -> pa.RecordBatch:
        reg, k = block(cfg).points(batch.column(len(kept)).to_numpy().view(np.uint64))
        found = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(reg.astype(np.int32)), pa.array(k.astype(np.int32))], names=[*kept, "reg", "k"])
        return found.filter(pa.array(k > 0))

    return _held_blocks(cfg, rows, kept, schema, limit is not None, sent, loose if one_point else None)


def partial_states(cfg: SketchFamily, df: DataFrame, element: str, keys: list[str], packed: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(keys..., state) with a row for each key and task at most: the task's registers, as ``packed`` writes them."""
    block(cfg)
    rows = df.where(F.col(element).isNotNull()).select(*keys, element_id(df, element).alias("__id"))
    schema = StructType(list(rows.select(*keys).schema.fields)).add("state", "binary")

    def sent(key: tuple, registers: MaxRegisters | MinRegisters, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, types)), pa.array([packed(registers.k)], pa.binary())], names=[*keys, "state"])

    return _held_blocks(cfg, rows, keys, schema, False, sent)
