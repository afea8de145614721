"""Dense sketches in one binary a key: a header that names the configuration, then m registers of fixed width.

Rows (keys..., reg, k) suit relational work; packed states suit storing, shipping
and comparing many sketches, as a state costs its registers' bits and a few bytes.
They are built, merged, compared and estimated by Arrow kernels that read whole
batches of states as arrays and never turn registers into rows.

Merging combines the states of a key inside each task first, then brings what is
left of a key together and folds it one state at a time, so a key with most of the
rows costs one state a task, and a task holds a bounded number of states.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from setforge.config import HyperMinHash, MinHash, Registers, SketchFamily
from setforge.operators import families, kernels
from setforge.operators.cardinality import corrections, ml_from_histograms

MAGIC = b"SFP1"
#: Registers that are unpacked together.
TOGETHER = 1 << 19


families.width.register(MinHash, lambda cfg: cfg.span.bit_length())
families.width.register(HyperMinHash, lambda cfg: cfg.bucket_size + 1 + cfg.sub_bits)
families.width.register(Registers, lambda cfg: (cfg.q + 1).bit_length())
width, empty = families.width, families.empty


def header(cfg: SketchFamily) -> bytes:
    """Names the configuration; equal configurations have equal headers."""
    info = json.dumps(cfg.info(), sort_keys=True).encode()
    return MAGIC + len(info).to_bytes(2, "little") + info


def size(cfg: SketchFamily) -> int:
    """Bytes of a packed state."""
    return len(header(cfg)) + (cfg.m * width(cfg) + 7) // 8


def info(state: bytes) -> dict[str, str]:
    """The configuration that a state's header names."""
    if state[: len(MAGIC)] != MAGIC:
        raise ValueError("not a packed state")
    start = len(MAGIC) + 2
    return json.loads(state[start : start + int.from_bytes(state[len(MAGIC) : start], "little")])


def to_states(cfg: SketchFamily, registers: np.ndarray) -> list[bytes]:
    """Pack an array (states, m)."""
    head, bits = header(cfg), width(cfg)
    out = []
    step = max(1, TOGETHER // cfg.m)
    for lo in range(0, len(registers), step):
        part = np.ascontiguousarray(registers[lo : lo + step])
        if bits in (8, 16, 32):
            rows = part.astype(f">u{bits // 8}").view(np.uint8)
        else:
            wide = 8 * (1 if bits < 8 else 2 if bits < 16 else 4 if bits < 32 else 8)
            single = np.unpackbits(part.astype(f">u{wide // 8}").view(np.uint8).reshape(len(part), cfg.m, wide // 8), axis=2)[:, :, wide - bits :]
            rows = np.packbits(single.reshape(len(part), cfg.m * bits), axis=1)
        out += [head + row.tobytes() for row in rows]
    return out


def from_states(cfg: SketchFamily, states: list[bytes]) -> np.ndarray:
    """The array (states, m) of packed states; raises where a state has another configuration."""
    head, bits = header(cfg), width(cfg)
    length = size(cfg)
    for state in states:
        if not state.startswith(head) or len(state) != length:
            raise ValueError(f"a packed state is not of {cfg}, but of {info(state)}")
    out = np.empty((len(states), cfg.m), np.int64)
    step = max(1, TOGETHER // cfg.m)
    for lo in range(0, len(states), step):
        part = states[lo : lo + step]
        body = np.frombuffer(b"".join(s[len(head) :] for s in part), np.uint8).reshape(len(part), length - len(head))
        if bits in (8, 16, 32):
            out[lo : lo + step] = body.view(f">u{bits // 8}")
            continue
        wide = 8 * (1 if bits < 8 else 2 if bits < 16 else 4 if bits < 32 else 8)
        single = np.zeros((len(part), cfg.m, wide), np.uint8)
        single[:, :, wide - bits :] = np.unpackbits(body, axis=1)[:, : cfg.m * bits].reshape(len(part), cfg.m, bits)
        out[lo : lo + step] = np.packbits(single, axis=2).reshape(len(part), -1).view(f">u{wide // 8}").reshape(len(part), cfg.m)
    return out


def batches_of(cfg: SketchFamily, states: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first, registers) of as many states as are unpacked together."""
    step = max(1, TOGETHER // cfg.m)
    for lo in range(0, len(states), step):
        yield lo, from_states(cfg, states[lo : lo + step])


def _schema(df: DataFrame, keys: list[str]) -> StructType:
    return StructType(list(df.select(*keys).schema.fields)).add("state", "binary")


# ---- building and merging -------------------------------------------------


def pack(cfg: SketchFamily, sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., state) from rows (keys..., reg, k)."""
    held = sketches.groupBy(*keys).agg(F.collect_list("reg").alias("regs"), F.collect_list("k").alias("ks"))
    none, m = empty(cfg), cfg.m

    def run(regs: pd.Series, ks: pd.Series) -> pd.Series:
        out: list[bytes] = []
        step = max(1, TOGETHER // m)
        for lo in range(0, len(regs), step):
            dense = np.full((len(regs.iloc[lo : lo + step]), m), none, np.int64)
            for row, (reg, k) in enumerate(zip(regs.iloc[lo : lo + step], ks.iloc[lo : lo + step])):
                dense[row, reg] = k
            out += to_states(cfg, dense)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"regs": pd.Series, "ks": pd.Series, "return": pd.Series}
    return held.select(*keys, F.pandas_udf(run, "binary")("regs", "ks").alias("state"))


def unpack(cfg: SketchFamily, states: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys..., reg, k) of the registers that were touched."""
    none = empty(cfg)

    def run(state: pd.Series) -> pd.Series:
        return pd.Series([list(row) for _, part in batches_of(cfg, list(state)) for row in part], dtype=object)

    run.__annotations__ = {"state": pd.Series, "return": pd.Series}
    found = states.select(*keys, F.posexplode(F.pandas_udf(run, "array<bigint>")("state")).alias("reg", "k")).where(F.col("k") != none)
    return found if isinstance(cfg, MinHash) else found.withColumn("k", F.col("k").cast("int"))


def build_packed(cfg: SketchFamily, df: DataFrame, element: str, keys: list[str]) -> DataFrame:
    """(keys..., state) of the elements of each key; a task ships one state a key instead of a row a register."""
    return merge_packed(cfg, kernels.partial_states(cfg, df, element, keys, lambda k: to_states(cfg, k[None, :])[0]), keys)


def _folded(cfg: SketchFamily, states: DataFrame, keys: list[str], most: int) -> DataFrame:
    """States with equal keys folded within a task, of which ``most`` keys are held."""
    better = np.minimum if families.keeps(cfg) == "min" else np.maximum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def out(found: list[tuple[tuple, np.ndarray]]) -> pa.RecordBatch:
            columns = [pa.array([key[i] for key, _ in found], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(to_states(cfg, np.stack([k for _, k in found])), pa.binary())], names=[*keys, "state"])

        for batch in batches:
            types = [c.type for c in batch.columns[:-1]]
            values = list(zip(*(c.to_pylist() for c in batch.columns[:-1]))) or [()] * batch.num_rows
            for lo, registers in batches_of(cfg, batch.column(len(keys)).to_pylist()):
                for key, k in zip(values[lo : lo + len(registers)], registers):
                    if key in held:
                        better(held[key], k, out=held[key])
                        continue
                    if len(held) >= most:  # the key that came first goes
                        first = next(iter(held))
                        yield out([(first, held.pop(first))])
                    held[key] = k.copy()
        if held:
            yield out(list(held.items()))

    return states.mapInArrow(run, _schema(states, keys))


def merge_packed(cfg: SketchFamily, states: DataFrame, keys: list[str]) -> DataFrame:
    """Union of all states with the same keys; raises where a configuration differs."""
    partial = _folded(cfg, states.select(*keys, "state"), keys, max(1, (64 << 20) // (8 * cfg.m)))
    if not keys:
        return _folded(cfg, partial.coalesce(1), keys, 1)
    # equal keys come one after another, so one state is held
    return _folded(cfg, partial.repartition(*keys).sortWithinPartitions(*keys), keys, 1)


# ---- estimating and comparing ---------------------------------------------


def _simple(cfg: SketchFamily, k: np.ndarray) -> np.ndarray:
    if isinstance(cfg, MinHash):
        full = (k < cfg.span).all(axis=1)
        total = -np.log1p(-(k + 0.5) / float(cfg.span), where=k < cfg.span, out=np.zeros(k.shape)).sum(axis=1)
        return np.where(full, cfg.m / np.where(full, total, 1.0), 0.0)
    if isinstance(cfg, HyperMinHash):
        return _simple(cfg.as_hll(), k >> cfg.sub_bits)
    zeros, tops = (k == 0).sum(axis=1), (k > cfg.q).sum(axis=1)
    inner = np.where((k > 0) & (k <= cfg.q), cfg.b ** -k.astype(float), 0.0).sum(axis=1)
    if cfg.range_correction:
        low, high = (np.array(c) for c in corrections(cfg.m, cfg.b))
        total = inner + cfg.m * low[zeros] + cfg.m * cfg.b**-cfg.q * high[tops]
    else:
        total = inner + zeros + tops * cfg.b ** -(cfg.q + 1)
    with np.errstate(divide="ignore"):
        return cfg.m * (1 - 1 / cfg.b) / (cfg.rate * cfg.log_b) / total


def _ml(cfg: Registers, k: np.ndarray) -> np.ndarray:
    held = [np.unique(row, return_counts=True) for row in k]
    return ml_from_histograms(cfg, [h[0] for h in held], [h[1] for h in held])


def estimate(cfg: SketchFamily, state: Column, ml: bool = False) -> Column:
    """Cardinality of a packed state, by the corrected harmonic mean (MinHash and HyperMinHash: their own) or by maximum likelihood."""
    if ml and not isinstance(cfg, Registers):
        raise ValueError("maximum likelihood is for register families")
    solve = _ml if ml else _simple

    def run(state: pd.Series) -> pd.Series:
        found = [solve(cfg, part) for _, part in batches_of(cfg, list(state))]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    run.__annotations__ = {"state": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(state)


COMPARED = ("d_plus", "d_minus", "d_equal", "both_zero", "both_top", "filled", "matches")


def compare(cfg: SketchFamily, first: Column, second: Column) -> Column:
    """Struct of ``COMPARED``: how the registers of two packed states compare."""
    none, top = empty(cfg), getattr(cfg, "q", math.inf) + 1

    def run(first: pd.Series, second: pd.Series) -> pd.DataFrame:
        parts = []
        for (_, a), (_, b) in zip(batches_of(cfg, list(first)), batches_of(cfg, list(second))):
            zero = (a == none) & (b == none)
            parts.append(np.stack([(a > b).sum(1), (a < b).sum(1), (a == b).sum(1), zero.sum(1), ((a == top) & (b == top)).sum(1), (~zero).sum(1), ((a == b) & ~zero).sum(1)], axis=1))
        return pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(COMPARED)), np.int64), columns=COMPARED)

    run.__annotations__ = {"first": pd.Series, "second": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ", ".join(f"{c} long" for c in COMPARED))(first, second)


def pairs_packed(cfg: SketchFamily, states: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Like ``joint.pairs`` with n1 and n2, from packed states (key, state): two joins by key and one kernel."""
    sized = states.select(F.col(key), "state", estimate(cfg, F.col("state")).alias("n"))
    one = sized.select(F.col(key).alias("k1"), F.col("state").alias("__s1"), F.col("n").alias("n1"))
    two = sized.select(F.col(key).alias("k2"), F.col("state").alias("__s2"), F.col("n").alias("n2"))
    both = wanted.select("k1", "k2").join(one, "k1").join(two, "k2")
    return both.select("k1", "k2", "n1", "n2", compare(cfg, F.col("__s1"), F.col("__s2")).alias("c")).select("k1", "k2", "n1", "n2", "c.*")
