"""Near-duplicate documents by an LSH forest.

A document is its set of word shingles.  Documents with equal sets are one
class, represented by the smallest id.  Each class gets a minimum-hash signature
of ``TREES`` groups of ``DEPTH`` values; every group is one sorted order of all
classes.  Candidates are longest-common-prefix neighbours.  A region is a run of
classes that share ``LEAST`` values; in a region of up to ``WINDOW`` + 1 classes
all are candidates of each other.  In a larger one each class is first paired with
its neighbour in the order and with the first class of the deepest region it
shares with an earlier one, whose firsts are paired likewise.  Candidates whose
signatures agree in five standard deviations less places than the threshold asks
for are dropped (of a million links that loses less than one); the rest are
confirmed on the full sets, in two rounds: first one candidate a class, then
those that still connect different components.  Larger regions, and those a
partition boundary may have cut, then go through an exact pass: all pairs of
their classes that lie in different components are compared on the full sets.

Scale: the orders are range partitioned on all their values and the id, so a
group of copies is spread over tasks; no group is gathered anywhere.  The exact
pass deals a region out in cells of bounded size, each of some classes outside
the region's largest component against some of all; its cost is the product of
these two numbers, so a group found in one component is not dealt out, and only a
large one that does not link costs the square of its size.  Equal sets meet in a partially aggregated minimum.  Only classes with a candidate have
their texts read again for full sets; a bit table of fixed size sifts out most
others before sets are shuffled (a full one only costs work).

Defined cases: null text or text without words is an empty set, linked with
nothing; with fewer words than a shingle has, the whole sequence is the only
shingle; rows with equal ids are one node of the graph; an empty table gives an
empty result.  A null id counts as larger than any: such a row belongs to the
component of an equal set with an id, else it stands alone (component null, kept).
Other columns are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.components import components
from setforge.llm.shared import Shelf, as_bytes, freeing, map_batches

TREES, DEPTH, LEAST, WINDOW = 20, 8, 4, 6
#: Trees of each round of the exact pass; the first ones leave little to the others.
ROUNDS = (range(4), range(4, TREES))
#: Hashes on each side of a cell of the exact pass, about.
CELL = 1 << 17
#: Bits of the table that sifts documents.
SIEVE = 1 << 24
_STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(0, 1 << 32, TREES * DEPTH, np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint32)[:, None]


def shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = hashed[:n].copy()
    for j in range(1, width):
        mixed ^= mixed >> np.uint64(32)
        mixed = mixed * _STEP + hashed[j : j + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(hashed: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minimum hashes."""
    low = hashed.astype(np.uint32)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        values = low[k : k + 2048] * _MUL
        values += _ADD
        values ^= values >> np.uint32(15)
        np.minimum(out, values.min(axis=1), out=out)
    return out


def summaries(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, key, sig, brief); all but n are null for empty sets.  ``brief`` is the last byte of each value of ``sig``."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in as_bytes(batch.column(1)):
                hashed = shingles(text, width)
                if len(hashed):
                    sig = signature(hashed)
                    rows.append((len(hashed), xxhash.xxh3_128_digest(hashed.tobytes()), sig.astype(">u4").tobytes(), sig.astype(np.uint8).tobytes()))
                else:
                    rows.append((0, None, None, None))
            n, *binary = zip(*rows)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in binary)], names=["id", "n", "key", "sig", "brief"])

        return one

    return map_batches(docs.select(id_col, text_col), make, f"id {id_type}, n bigint, key binary, sig binary, brief binary")


def sorted_orders(classes: DataFrame) -> DataFrame:
    """(tree, sig, id) in all orders; each partition is sorted."""
    id_type = classes.schema["id"].dataType.simpleString()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n * TREES, 4 * DEPTH)
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * DEPTH), n * TREES, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
            tree = np.tile(np.arange(TREES, dtype=np.int32), n)
            return pa.RecordBatch.from_arrays([pa.array(tree), data, batch.column(0).take(pa.array(np.repeat(np.arange(n), TREES)))], names=["tree", "sig", "id"])

        return one

    rows = map_batches(classes.select("id", "sig"), make, f"tree int, sig binary, id {id_type}")
    return rows.repartitionByRange("tree", "sig", "id").sortWithinPartitions("tree", "sig", "id")


def _regions(key: np.ndarray) -> np.ndarray:
    """A number for the region of each row of (tree, value, value, ...)."""
    out = np.zeros(len(key), np.uint64)
    for column in key[:, : LEAST + 1].T:
        out = (out ^ column.astype(np.uint64)) * _STEP
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def neighbours(orders: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the sorted orders; other rows name an ``edge``, the region at an end of a partition."""
    id_type = orders.schema["id"].dataType.simpleString()
    depths = sorted({LEAST, (LEAST + DEPTH) // 2, DEPTH})

    def edge(key: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, kind), pa.array(_regions(key))], names=["a", "b", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last rows of the batch before: key matrix and ids
        open_: dict[int, tuple] = {}  # depth: (key of the region that may go on, its first id, its rows so far)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(n, DEPTH)
            key = np.column_stack([np.asarray(batch.column(0)).astype(np.int64), sig.astype(np.int64)])
            if before is None:
                yield edge(key[:1], batch.column(2).type)
            place, leader, carried = {}, {}, {}  # by depth: rows of the region before a row, index of its first row, id where that is gone
            for depth in depths:
                starts = np.ones(n, bool)
                starts[1:] = (key[1:, : depth + 1] != key[:-1, : depth + 1]).any(axis=1)
                first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
                place[depth], leader[depth] = np.arange(n) - first, first
                last = open_.get(depth)
                if last is not None and (last[0] == key[0, : depth + 1]).all():
                    goes_on = first == 0
                    place[depth][goes_on] += last[2]
                    leader[depth][goes_on] = -1
                    carried[depth] = last[1]
                own = leader[depth][-1]
                open_[depth] = (key[-1, : depth + 1].copy(), carried[depth] if own < 0 else batch.column(2)[int(own)].as_py(), int(place[depth][-1]) + 1)
            ids, shift = batch.column(2), 0
            if before is not None:
                shift, ids = len(before), pa.concat_arrays([before, ids])
            ones, twos = [], []
            for back in range(1, WINDOW + 1):
                near = place[LEAST] >= back
                if back > 1:
                    near &= place[LEAST] <= WINDOW
                rows = np.flatnonzero(near)
                rows = rows[rows + shift >= back]
                ones.append(rows + shift - back)
                twos.append(rows + shift)
            a, b = ids.take(pa.array(np.concatenate(ones))), ids.take(pa.array(np.concatenate(twos)))
            far = place[LEAST] > WINDOW
            for depth in reversed(depths):
                rows = np.flatnonzero(far & (place[depth] > 0))
                far[rows] = False
                gone = leader[depth][rows] < 0
                held = rows[~gone]
                parts = [(ids.take(pa.array(leader[depth][held] + shift)), ids.take(pa.array(held + shift)))]
                if gone.any():
                    parts.append((pa.array([carried[depth]] * int(gone.sum()), ids.type), ids.take(pa.array(rows[gone] + shift))))
                for x, y in parts:
                    a, b = pa.concat_arrays([a, x]), pa.concat_arrays([b, y])
            before = ids.slice(max(0, len(ids) - WINDOW))
            if len(a):
                yield pa.RecordBatch.from_arrays([a, b, pa.nulls(len(a), pa.int64())], names=["a", "b", "edge"])
        if before is not None:
            yield edge(key[-1:], before.type)

    found = orders.mapInArrow(freeing(run), f"a {id_type}, b {id_type}, edge bigint")
    return found.where("a <> b OR edge IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "edge").distinct()


def members(classes: DataFrame) -> DataFrame:
    """(tree, region, id, n) of all classes in all orders."""
    id_type = classes.schema["id"].dataType.simpleString()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(n * TREES, DEPTH)
            tree, at = np.tile(np.arange(TREES, dtype=np.int32), n), pa.array(np.repeat(np.arange(n), TREES))
            region = _regions(np.column_stack([tree, sig[:, :LEAST].astype(np.int64)]))
            return pa.RecordBatch.from_arrays([pa.array(tree), pa.array(region), batch.column(0).take(at), batch.column(1).take(at)], names=["tree", "region", "id", "n"])

        return one

    return map_batches(classes.where("id IS NOT NULL").select("id", "n", "sig"), make, f"tree int, region bigint, id {id_type}, n bigint")


def cells(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(region, i, j, minor, id, comp): for all pairs of ``rows`` in a region but not in a component, a cell (region, i, j) that holds both.

    Each pair has a class outside the region's largest component; these are dealt over i and all classes over j.
    """
    rows = rows.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    held = rows.groupBy("region", "comp").agg(F.sum("n").alias("n"))
    held = held.groupBy("region").agg(F.sum("n").alias("total"), F.max(F.struct("n", "comp")).alias("most")).where("total > most.n")
    held = held.select("region", F.col("most.comp").alias("major"), F.ceil((F.col("total") - F.col("most.n")) / CELL).alias("ni"), F.ceil(F.col("total") / CELL).alias("nj"))
    open_ = rows.join(held, "region")
    place = F.xxhash64("id", F.lit("cell"))
    one = open_.where("comp <> major").select("region", F.pmod(place, "ni").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nj") - 1)).alias("j"), F.lit(True).alias("minor"), "id", "comp")
    other = open_.select("region", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ni") - 1)).alias("i"), F.pmod(place, "nj").alias("j"), F.lit(False).alias("minor"), "id", "comp")
    return one.unionByName(other)


def linked(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all components which any pair in a cell joins."""
    id_type = cells.schema["id"].dataType.simpleString()
    cells = cells.join(sets, "id").select("region", "i", "j", "minor", "id", "comp", "hashes")

    def one(table: pa.Table) -> pa.Table:
        minor, ids, comps = (table.column(c).to_pylist() for c in ("minor", "id", "comp"))
        hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        sizes = np.array([len(h) for h in hashes])
        number = {c: k for k, c in enumerate(dict.fromkeys(comps))}
        group = np.array([number[c] for c in comps], np.int64)
        right = np.array([k for k, m in enumerate(minor) if not m], np.int64)
        a, b = [], []
        if len(right):
            distinct, inner = np.unique(np.concatenate([hashes[k] for k in right]), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes[right])[:-1]])
            flags = np.zeros(len(distinct), np.int32)
            for k in (k for k, m in enumerate(minor) if m):
                at = np.minimum(np.searchsorted(distinct, hashes[k]), len(distinct) - 1)
                at = at[distinct[at] == hashes[k]]
                flags[at] = 1
                common = np.add.reduceat(flags[inner], starts)
                flags[at] = 0
                for other in right[100 * common >= percent * (sizes[k] + sizes[right] - common)]:
                    if group[other] != group[k]:
                        group[group == group[other]] = group[k]
                        a.append(min(ids[k], ids[other]))
                        b.append(max(ids[k], ids[other]))
        kind = table.schema.field("id").type
        return pa.table([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    return cells.groupBy("region", "i", "j").applyInArrow(one, f"a {id_type}, b {id_type}")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose sets' intersection is at least ``percent`` of their union."""
    id_type = pairs.schema["a"].dataType.simpleString()
    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b").select("a", "b", "ha", "hb")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = sorted((len(x), len(y)))
                if 100 * small < percent * large:
                    good.append(False)
                    continue
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(merged[1:] == merged[:-1]))
                good.append(100 * common >= percent * (small + large - common))
            mask = pa.array(good, pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

        return one

    return map_batches(both, make, f"a {id_type}, b {id_type}")


def agreeing(pairs: DataFrame, briefs: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose signatures (one byte a value) agree often enough; ``briefs`` is (id, brief)."""
    id_type = pairs.schema["a"].dataType.simpleString()
    n, p = TREES * DEPTH, percent / 100
    least = n * (p - 5 * (p * (1 - p) / n) ** 0.5)
    first = pairs.join(briefs.select(F.col("id").alias("a"), F.col("brief").alias("sa")), "a")
    both = first.join(briefs.select(F.col("id").alias("b"), F.col("brief").alias("sb")), "b").select("a", "b", "sa", "sb")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, n) for c in (2, 3))
            mask = pa.array((x == y).sum(axis=1) >= least)
            return pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

        return one

    return map_batches(both, make, f"a {id_type}, b {id_type}")


def _bits_of(ids: pa.Array) -> np.ndarray:
    """Two places in the sieve for each id."""
    found = np.fromiter((xxhash.xxh3_64_intdigest(str(x)) for x in ids.to_pylist()), np.uint64, len(ids))
    return np.stack([found & np.uint64(SIEVE - 1), (found >> np.uint64(32)) & np.uint64(SIEVE - 1)]).astype(np.int64)


def sieve_of(ids: DataFrame) -> np.ndarray:
    """A bit table that holds all of ``ids``, and few others while it is not full."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SIEVE // 8, np.uint8)
        for batch in batches:
            at = _bits_of(batch.column(0)).reshape(-1)
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(table)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].astype(np.int64))], names=["place", "bits"])

    held = ids.mapInArrow(freeing(bits), "place bigint, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(SIEVE // 8, np.uint8)
    table[held["place"].to_numpy(np.int64)] = held["bits"].to_numpy(np.uint8)
    return table


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, hashes) for the documents named by ``ids``; one pass of Python sifts them and finds their shingles."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(sieve_of(ids))

    def make():
        table = sent.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = _bits_of(batch.column(0))
            batch = batch.filter(pa.array(((table[at >> 3] >> (at & 7)) & 1).all(axis=0)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, width).tobytes() for t in as_bytes(batch.column(1))], pa.binary())], names=["id", "hashes"])

        return one

    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(wanted, make, f"id {id_type}, hashes binary").join(ids, "id", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``."""
    shelf = Shelf(docs.sparkSession, "near")
    found = shelf.put(summaries(docs, id_col, text_col, width), "summaries")
    groups = found.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"))
    mapped = found.join(groups, "key", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"), *(F.when(F.col("id") == F.col("rep"), F.col(c)).alias(c) for c in ("sig", "brief")))
    mapped = shelf.put(mapped, "mapped")
    shelf.drop("summaries")
    classes = mapped.where("sig IS NOT NULL")
    near = shelf.put(neighbours(sorted_orders(classes)), "neighbours")
    pairs = shelf.put(agreeing(near.where("edge IS NULL").select("a", "b"), classes.select("id", "brief").dropDuplicates(["id"]), percent), "pairs")
    rows = members(classes)
    crowded = rows.groupBy("region").agg(F.count(F.lit(1)).alias("rows")).join(near.where("edge IS NOT NULL").select(F.col("edge").alias("region"), F.lit(True).alias("cut")).distinct(), "region", "left")
    crowded = crowded.where(F.col("rows") > F.when(F.col("cut"), 1).otherwise(WINDOW + 1)).select("region")
    crowded = shelf.put(rows.join(shelf.put(crowded, "regions"), "region", "left_semi"), "crowded")
    shelf.drop("neighbours")
    named = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = shelf.put(full_sets(docs, named, id_col, text_col, width), "sets")
    links = shelf.put(confirmed(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, percent), "links-1")
    parts = components(links, shelf, "first")
    left = pairs.join(parts.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(parts.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    left = left.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    tried = pairs.groupBy("b").agg(F.min("a").alias("a"))
    more = shelf.put(confirmed(left.join(tried, ["a", "b"], "left_anti"), sets, percent), "links-2")
    links = links.unionByName(more)
    parts = components(links, shelf, "second")
    for turn, trees in enumerate(ROUNDS):
        dealt = shelf.put(cells(crowded.where(F.col("tree").isin(*trees)), parts), f"cells-{turn}")
        if dealt.isEmpty():
            continue
        held = full_sets(docs, dealt.select("id").distinct(), id_col, text_col, width)
        more = shelf.put(linked(dealt, held, percent), f"exact-{turn}")
        if not more.isEmpty():
            links = links.unionByName(more)
            parts = components(links, shelf, f"exact-{turn}-parts")
    shelf.drop("pairs", "regions", "crowded", "sets", "links-1", "links-2", *(f"{x}-{turn}" for turn in range(len(ROUNDS)) for x in ("cells", "exact")))
    out = mapped.join(parts, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
