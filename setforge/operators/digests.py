"""Registers of the ``md5`` scheme for families in which an element updates every register.

Such a sketch takes m digests of each element, so they are computed on arrays: a
batch of elements of one length is one block of messages, whose last words alone
differ by register.  Rows come sorted by key (``clustered``), so that a batch holds
few keys and sends one row a key and register.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from setforge.config import MinHash, SetSketch1, SetSketch2

#: Digests that are computed together; their words stay inside a core's cache.
TOGETHER = 1 << 15
#: A batch whose elements come so often on average gets a table of what they give, of at most so many values.
REPEATS, TABLE = 2, 1 << 21
#: Longest message of one block; longer ones are hashed one by one.
ONE_BLOCK = 55
#: Constants of RFC 1321.
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_blocks(words: list[np.ndarray | None], shape: tuple[int, ...]) -> list[np.ndarray]:
    """The four words, as big-endian numbers, of the MD5 digests of single blocks; ``words`` are 16 arrays that broadcast to ``shape`` (None: zero)."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            g = i
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(f, a, out=f)
        np.add(f, np.uint32(_SINES[i]) if words[g] is None else words[g] + np.uint32(_SINES[i]), out=f)
        left = _TURNS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - left), out=t), np.left_shift(f, np.uint32(left), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [(v + np.uint32(s)).byteswap() for v, s in zip((a, b, c, d), _START)]


def _words(texts: list[bytes], size: int) -> np.ndarray:
    """(16, n) little-endian words of texts of ``size`` bytes."""
    block = np.zeros((len(texts), 64), np.uint8)
    if size:
        block[:, :size] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), size)
    return np.ascontiguousarray(block.view("<u4").T)


def digests(texts: list[bytes], m: int) -> list[np.ndarray]:
    """The digests of ``text|reg`` for reg = 0 .. m-1: four arrays (texts, m) of big-endian words."""
    out = [np.empty((len(texts), m), np.uint32) for _ in range(4)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    tails = [b"|%d" % r for r in range(m)]
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        first = 0
        while first < m:
            last = min(m, 10 if first == 0 else first * 10)  # registers of as many digits
            length = int(size) + len(tails[first])
            if length > ONE_BLOCK:
                for row in rows:
                    for reg in range(first, last):
                        for o, v in zip(out, np.frombuffer(hashlib.md5(texts[row] + tails[reg]).digest(), ">u4")):
                            o[row, reg] = v
            else:
                ends = _words([b"\0" * int(size) + t + b"\x80" for t in tails[first:last]], length + 1)
                ends[14] = 8 * length
                step = max(1, TOGETHER // (last - first))
                for lo in range(0, len(rows), step):
                    own = rows[lo : lo + step]
                    heads = _words([texts[i] for i in own], int(size))
                    words = [None if not (h.any() or e.any()) else h[:, None] | e[None, :] if h.any() and e.any() else h[:, None] if h.any() else e[None, :] for h, e in zip(heads, ends)]
                    for o, v in zip(out, md5_blocks(words, (len(own), last - first))):
                        o[own, first:last] = v
            first = last
    return out


def _unit(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """In (0, 1), from digits 9 to 21."""
    return ((b.astype(np.int64) << 20 | c >> np.uint32(12)) + 0.5) / float(16**13)


def points(cfg: SetSketch1 | SetSketch2, texts: list[bytes]) -> np.ndarray:
    """(texts, m): the point of each element for each register; see ``points.setsketch1_points`` and ``setsketch2_points``."""
    _, b, c, d = digests(texts, cfg.m)
    u = _unit(b, c)
    if isinstance(cfg, SetSketch1):
        return -np.log(u) / float(cfg.a)
    order = np.argsort((c & np.uint32(0xFF)).astype(np.int64) << 24 | d >> np.uint32(8), axis=1, kind="stable")  # digits 23 to 30
    stratum = np.empty_like(order)
    np.put_along_axis(stratum, order, np.arange(cfg.m)[None, :], 1)
    return -np.log1p(-(stratum + u) / float(cfg.m)) / float(cfg.a)


def values(cfg: MinHash | SetSketch1 | SetSketch2, texts: list[bytes], limits: np.ndarray | None = None) -> np.ndarray:
    """(texts, m): what each element gives each register; -1 where its point exceeds the element's limit."""
    if isinstance(cfg, MinHash):
        a, b, _, _ = digests(texts, cfg.m)
        return a.astype(np.int64) << 28 | b >> np.uint32(4)
    x = points(cfg, texts)
    k = np.clip(np.floor(1 - np.log(x) / math.log(cfg.b)), 0, cfg.q + 1).astype(np.int32)
    return k if limits is None else np.where(x <= limits[:, None], k, -1)


def clustered(rows: DataFrame, element: str, keys: list[str]) -> DataFrame:
    """Distinct ``rows`` by ranges of keys, sorted by them: a task holds few keys, and a key with most of the rows spans many tasks."""
    rows = rows.distinct()
    return rows.repartitionByRange(*keys, F.xxhash64(F.col(element).cast("string"))).sortWithinPartitions(*keys) if keys else rows


def _starts(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """Where runs of equal keys start."""
    changed = np.zeros(batch.num_rows, bool)
    changed[0] = True
    for column in batch.columns[:columns]:
        one, two = column.slice(1), column.slice(0, batch.num_rows - 1)
        if pa.types.is_nested(column.type):
            changed[1:] |= np.fromiter((a != b for a, b in zip(one.to_pylist(), two.to_pylist())), bool, batch.num_rows - 1)
            continue
        gone = [v.is_null().to_numpy(zero_copy_only=False) for v in (one, two)]
        changed[1:] |= pc.fill_null(pc.not_equal(one, two), True).to_numpy(zero_copy_only=False) & ~(gone[0] & gone[1])
    return np.flatnonzero(changed)


def _given(cfg: MinHash | SetSketch1 | SetSketch2, texts: pa.Array, limits: np.ndarray | None) -> Callable[[int, int], np.ndarray]:
    """``values`` of a range of the texts; elements that many keys share are hashed once, unless each has its own limit."""
    different = texts.unique() if limits is None else texts
    if REPEATS * len(different) <= len(texts) and len(different) * cfg.m <= TABLE:
        table, number = values(cfg, different.to_pylist()), pc.index_in(texts, different).to_numpy()
        return lambda lo, hi: table[number[lo:hi]]
    listed = texts.to_pylist()
    return lambda lo, hi: values(cfg, listed[lo:hi], None if limits is None else limits[lo:hi])


def updates(cfg: MinHash | SetSketch1 | SetSketch2, rows: DataFrame, element: str, keys: list[str], limit: str | None = None) -> DataFrame:
    """(keys..., reg, k), the best of each batch, from rows (keys..., element) without null elements; ``limit`` names a column above which points are left out, and is kept."""
    kept = [*keys, limit] if limit else keys
    source = clustered(rows.select(*kept, element), element, kept).select(*kept, F.col(element).cast("string").alias("__text"))
    wide = isinstance(cfg, MinHash)
    schema = StructType(list(source.select(*kept).schema.fields)).add("reg", "integer").add("k", "long" if wide else "integer")
    better, m = np.minimum if wide else np.maximum, cfg.m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, TOGETHER // m)
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, at = _starts(batch, len(kept)), len(kept)
            run_of = np.searchsorted(starts, np.arange(batch.num_rows), side="right") - 1
            found = np.full((len(starts), m), cfg.span if wide else -1, np.int64 if wide else np.int32)
            texts = batch.column(at).cast(pa.binary())
            limits = batch.column(at - 1).to_numpy() if limit else None
            give = _given(cfg, texts, limits)
            for lo in range(0, len(texts), step):
                k = give(lo, lo + step)
                own = run_of[lo : lo + step]
                cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                found[own[cuts]] = better(found[own[cuts]], better.reduceat(k, cuts, axis=0))
            row, reg = np.nonzero(found < cfg.span if wide else found >= 0)
            named = [c.take(pa.array(starts[row])) for c in batch.columns[:at]]
            yield pa.RecordBatch.from_arrays([*named, pa.array(reg.astype(np.int32)), pa.array(found[row, reg])], names=[*kept, "reg", "k"])

    return source.mapInArrow(run, schema)
