"""Removal of repeated byte strings with a sparse, distributed suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id.  Sorting every suffix would move tens of bytes for
each byte of text, so the array holds only suffixes at anchors: a position is
one if its 16-byte gram has the smallest hash in some window of grams that a
string of ``LENGTH`` bytes spans (winnowing).  Every such string contains such
an anchor of its own, decided by its bytes alone, and belongs to it.

1. Texts are dealt to parts of bounded size by their hash; copies of one text
   meet there and stand for one, of the smallest id, and each task sends a text
   once, however many copies it reads.
2. Each part sends the distinct hashes of its anchors; those of a single part
   and text are dropped.  This only filters: a false match costs work.
3. A part's suffixes at the remaining anchors, with the bytes before them that
   strings may have, form classes of equal bytes, so a passage that many texts
   share is one row a part.  Classes are range partitioned by sampled splitters
   on their leading sixteen bytes.
4. Each bucket sorts its suffixes by multikey quicksort, and likewise what
   precedes them.  For each start o bytes before the anchor, common prefixes of
   neighbours in both orders tell exactly which rows share 50 - o bytes from the
   anchor and o before it; all but the smallest id have a repeated string: a bit
   for each o.
5. Splitters cut between distinct grams, so no string has rows on two sides of a
   boundary.  A gram too common for one bucket is compared across boundaries: its
   suffixes are moved back to the starts of their strings, once a part and
   string, and splitters may then cut anywhere between distinct strings.
6. Bits return to their parts, whose bytes are then cut.

Scale: texts are shuffled once (all passes use the same exchange), about 12 bytes
for each distinct anchor of a part in step 2 and 80 for each class in step 3.
All exchanged rows have a fixed width and are dealt by Spark; the number of
parts, hash partitions and buckets grows with the input, their size does not.
The driver holds ``SAMPLES`` prefixes a bucket.

Defined cases: null text is empty; texts shorter than ``LENGTH`` keep all;
documents of equal id never remove from each other; ids are whole numbers, and a
null id counts as larger than any other; repeated rows are judged each on its
own; an empty table gives an empty result; other columns are neither read nor
returned, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setforge.llm.shared import freeing, map_batches

LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
#: Text bytes for each part, for each partition of hashes, and for each bucket of suffixes.
PART, HASH_BUCKET, SUFFIX_BUCKET = 12 << 20, 16 << 20, 32 << 20
#: Text bytes whose anchors are found at once.
SLICE = 1 << 19
#: Sampled anchors for each bucket; a gram with more than ``HOT`` of a bucket's sample is compared by whole strings.
SAMPLES, HOT = 200, 1 / 4
#: Places of an anchor's number in a reference; the part is above them, a string's start below.
ANCHOR = 31
NO_ID = (1 << 63) - 1
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _windows(x: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` over every window of ``size``."""
    span = 1
    while span * 2 <= size:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (size - span)], x[size - span :]) if span < size else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts joined: (joined bytes, start of each text, anchor positions, anchor hashes)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return data, starts, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, span = data.astype(np.uint64) + np.uint64(1), 1
    for multiplier in _MULTIPLIERS:
        h = h[:-span] * multiplier + h[span:]
        span *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    least = _windows(h, WINDOW, np.minimum)
    valid = np.zeros(len(least) + 1, np.int32)  # windows that lie in one text
    inside = sizes >= LENGTH
    np.add.at(valid, starts[inside], 1)
    np.add.at(valid, ends[inside] - LENGTH + 1, -1)
    least[np.cumsum(valid[:-1]) == 0] = 0
    pad = np.zeros(WINDOW - 1, np.uint64)
    most = _windows(np.concatenate([pad, least, pad]), WINDOW, np.maximum)
    at = np.flatnonzero((h == most) & (most > 0))
    return data, starts, at, h[at]


def reaches(at: np.ndarray, h: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor, how many bytes before it strings start that it stands for, least and most.

    An anchor stands for a string if its gram is the first of the smallest hash
    among the string's grams; only the string's own bytes decide that.
    """
    first, last = np.maximum(at - LEFT, begin), np.minimum(at, finish - LENGTH)
    live, back = np.arange(len(at)), 1
    while len(live := live[live >= back]):
        near = at[live] - at[live - back] <= LEFT
        live = live[near]
        stops = h[live - back] <= h[live]
        first[live[stops]] = np.maximum(first[live[stops]], at[live[stops] - back] + 1)
        live, back = live[~stops], back + 1
    live, ahead = np.arange(len(at)), 1
    while len(live := live[live + ahead < len(at)]):
        near = at[live + ahead] - at[live] <= LEFT
        live = live[near]
        stops = h[live + ahead] < h[live]
        last[live[stops]] = np.minimum(last[live[stops]], at[live[stops] + ahead] - WINDOW)
        live, ahead = live[~stops], ahead + 1
    return at - last, at - first


def slices(texts: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of texts of about ``SLICE`` bytes."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or i + 1 == len(texts):
            out.append((lo, i + 1))
            lo, size = i + 1, 0
    return out


# ---- sorting ---------------------------------------------------------------


def multikey_order(words: np.ndarray, small: int = 1024) -> np.ndarray:
    """Sorting order of rows of 64-bit keys, by three-way partitioning on one key at a time.

    Rows equal to the pivot go on with the next key; stretches of up to ``small``
    rows are sorted together at the end.
    """
    n, width = words.shape
    order = np.arange(n)
    stretch = np.zeros(n, np.int64)  # number of the small stretch that a place lies in
    stack, found = [(0, n, 0)], 0
    while stack:
        lo, hi, depth = stack.pop()
        if depth == width:
            continue
        if hi - lo <= small:
            found += 1
            stretch[lo:hi] = found
            continue
        own = order[lo:hi]
        values = words[own, depth]
        pivot = np.sort(values[:: max(1, len(values) // 31)])[16]
        less, equal = values < pivot, values == pivot
        order[lo:hi] = np.concatenate([own[less], own[equal], own[~(less | equal)]])
        a = lo + int(np.count_nonzero(less))
        b = a + int(np.count_nonzero(equal))
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    places = np.flatnonzero(stretch)
    if len(places):
        # stretches are numbered as the stack empties, which is not from left to right; places are
        own = order[places]
        number = np.cumsum(np.append(True, stretch[places][1:] != stretch[places][:-1]))
        order[places] = own[np.lexsort([*(words[own, d] for d in reversed(range(width))), number])]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes each row but the first shares with the row before it in ``order``."""
    differs = rows[order[1:]] != rows[order[:-1]]
    return np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])


def keys_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit keys that sort as they do."""
    n, size = rows.shape
    padded = np.zeros((n, -(-size // 8) * 8), np.uint8)
    padded[:, :size] = rows
    return padded.view(">u8").astype(np.uint64).reshape(n, -1)


def repeated_starts(ids: np.ndarray, least: np.ndarray, most: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Step 4: for each suffix, bit o tells that the string from o bytes before it occurs with a smaller id.

    ``right`` are bytes from the anchor on, ``left`` those before it, nearest first.
    """
    n = len(ids)
    bits = np.zeros(n, np.uint64)
    if n < 2:
        return bits
    orders = [multikey_order(keys_of(x)) for x in (right, left)]
    shared = [common_prefixes(x, o) for x, o in zip((right, left), orders)]

    def classes(which: int, size: int) -> np.ndarray:
        """A number for each row; equal numbers share ``size`` bytes."""
        out = np.empty(n, np.int64)
        out[orders[which]] = np.append(0, np.cumsum(shared[which] < size))
        return out

    for o in range(LEFT + 1):
        own = np.flatnonzero((least <= o) & (o <= most))
        if len(own) < 2:
            continue
        group = classes(0, LENGTH - o)[own] * n + classes(1, o)[own]
        by = np.argsort(group, kind="stable")
        own, group = own[by], group[by]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        smallest = np.repeat(np.minimum.reduceat(ids[own], first), np.diff(np.append(first, len(own))))
        bits[own[ids[own] > smallest]] |= np.uint64(1) << np.uint64(o)
    return bits


# ---- step 1: texts to parts --------------------------------------------------

_DEALT = "part int, key binary, id bigint, n bigint, text binary"


def dealt_texts(rows: DataFrame, parts: int) -> DataFrame:
    """Rows for the parts, of four kinds.

    (key, text): a text of ``LENGTH`` bytes or more, once a task; (key, id, n): the
    smallest id it has in the task, and of how many rows; (id, n): a copy of n
    bytes with a larger id, which loses all; (id, n, text): a shorter text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        turn = TaskContext.get().partitionId()

        def packed(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["part", "key", "id", "n", "text"])

        for batch in batches:
            found = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                turn += 1
                if len(text) < LENGTH:
                    found.append((turn % parts, None, ident, len(text), text))
                    continue
                key = hashlib.blake2b(text, digest_size=16).digest()
                before = held.get(key)
                if before is None:
                    held[key] = [ident, 1]
                    found.append((xxhash.xxh3_64_intdigest(key) % parts, key, None, None, text))
                elif ident == before[0]:
                    before[1] += 1
                else:
                    losers = (ident, 1) if ident > before[0] else tuple(before)
                    if ident < before[0]:
                        held[key] = [ident, 1]
                    found += [(turn % parts, None, losers[0], len(text), None)] * losers[1]
            if found:
                yield packed(found)
        ends = list(held.items())
        for k in range(0, len(ends), 10_000):
            yield packed([(xxhash.xxh3_64_intdigest(key) % parts, key, ident, n, None) for key, (ident, n) in ends[k : k + 10_000]])

    return rows.mapInArrow(freeing(run), _DEALT)


class Part:
    """The distinct texts of a part in the order of their keys, with their anchors."""

    def __init__(self, table: pa.Table):
        by_key: dict[bytes, list] = {}
        for key, ident, n, text in zip(*(table[c].to_pylist() for c in ("key", "id", "n", "text"))):
            if key is not None:
                own = by_key.setdefault(key, [None, []])
                if text is not None:
                    own[0] = text
                else:
                    own[1].append((ident, n))
        keys = sorted(by_key)
        self.texts = [by_key[k][0] for k in keys]
        self.rows = [by_key[k][1] for k in keys]
        self.ids = np.array([min(i for i, _ in r) for r in self.rows], np.int64)
        self.found = []  # by slice: (bytes, starts of texts, anchor places, first text)
        docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo, hi in slices(self.texts):
            data, starts, at, h = anchors(self.texts[lo:hi])
            self.found.append((data, starts, at, lo))
            docs.append(np.searchsorted(starts, at, "right") - 1 + lo)
            hashes.append(h)
        self.doc, self.hash = np.concatenate(docs), np.concatenate(hashes)
        self.distinct, self.of, self.times = np.unique(self.hash, return_inverse=True, return_counts=True)

    def context(self, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of wanted anchors that stand for any string: (number, place in the text, least, most, right, left)."""
        out, first = [], 0
        for data, starts, at, lo in self.found:
            last = first + len(at)
            of = self.doc[first:last] - lo
            if len(data) and wanted[first:last].any():
                least, most = reaches(at, self.hash[first:last], starts[of], np.append(starts[1:], len(data))[of])
                own = np.flatnonzero(wanted[first:last] & (least <= most))
                place, least, most = at[own], least[own], most[own]
                padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
                right = padded[(place + LEFT)[:, None] + np.arange(LENGTH)]
                right[np.arange(LENGTH) >= LENGTH - least[:, None]] = 0
                left = padded[(place + LEFT - 1)[:, None] - np.arange(LEFT)]
                left[np.arange(LEFT) >= most[:, None]] = 0
                out.append((own + first, place - starts[of[own]], least, most, right, left))
            first = last
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros((0, LENGTH), np.uint8), np.zeros((0, LEFT), np.uint8)
        return tuple(np.concatenate(c) for c in zip(*out))


def equal_rows(rows: np.ndarray) -> np.ndarray:
    """A number for each row of bytes, the same for equal rows only."""
    if not len(rows):
        return np.zeros(0, np.int64)
    keys = keys_of(rows)
    mixed = np.zeros(len(rows), np.uint64)
    for column in keys.T:
        mixed = (mixed ^ column) * _MULTIPLIERS[0]
        mixed ^= mixed >> np.uint64(29)
    _, first, number = np.unique(mixed, return_index=True, return_inverse=True)
    if (keys[first[number]] != keys).any():  # two rows of one hash
        number = np.unique(rows.view([("", np.uint8)] * rows.shape[1]).reshape(-1), return_inverse=True)[1]
    return number


def firsts(number: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each class: its smallest id, and the first row that has it."""
    order = np.lexsort((np.arange(len(ids)), ids, number))
    start = np.flatnonzero(np.append(True, number[order][1:] != number[order][:-1])) if len(order) else np.zeros(0, np.int64)
    return ids[order[start]], order[start]


class Classes:
    """Wanted anchors of a part in classes of equal bytes, and the strings of those with a hot gram."""

    def __init__(self, part: Part, wanted: np.ndarray, hot: np.ndarray):
        self.anchor, self.place, self.least, self.most, self.right, self.left = part.context(wanted)
        self.doc = part.doc[self.anchor]
        self.id = part.ids[self.doc]
        both = np.column_stack([self.right, self.left, self.least.astype(np.uint8), self.most.astype(np.uint8)])
        self.number = equal_rows(both)
        self.smallest, self.first = firsts(self.number, self.id)
        grams = np.ascontiguousarray(self.right[self.first, :GRAM]).view(f"S{GRAM}").reshape(-1)
        self.hot = np.isin(grams, hot) if len(hot) else np.zeros(len(grams), bool)

    def strings(self) -> tuple[np.ndarray, ...]:
        """(bytes, number, class, o) for every string of a hot class."""
        of = np.flatnonzero(self.hot)
        least, most = self.least[self.first[of]], self.most[self.first[of]]
        which = np.repeat(of, most - least + 1)
        o = np.arange(len(which)) - np.repeat(np.cumsum(most - least + 1) - (most - least + 1), most - least + 1) + np.repeat(least, most - least + 1)
        rows = np.concatenate([self.left[self.first][:, ::-1], self.right[self.first]], axis=1)
        text = rows[which[:, None], LEFT - o[:, None] + np.arange(LENGTH)] if len(which) else np.zeros((0, LENGTH), np.uint8)
        return text, equal_rows(text), which, o


# ---- steps 2 to 6 ------------------------------------------------------------


def anchor_hashes(dealt: DataFrame, bits: int) -> DataFrame:
    """Step 2: (h, ref) of each distinct anchor hash of a part; ``bits`` of the hash."""

    def find(table: pa.Table) -> pa.Table:
        part, number = Part(table), table["part"][0].as_py()
        # the upper bits of the hash in the upper bytes of the value, where shuffles compress best
        h = part.distinct >> np.uint64(64 - bits) << np.uint64(63 - bits)
        return pa.table([pa.array(h.astype(np.int64)), pa.array((np.int64(number) << ANCHOR) + np.arange(len(h)))], names=["h", "ref"])

    return dealt.groupBy("part").applyInArrow(find, "h bigint, ref bigint")


def shared_hashes(hashes: DataFrame, buckets: int) -> DataFrame:
    """Step 2: (part, number) of the hashes that several parts have."""
    found = hashes.repartition(buckets, "h").withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("times > 1")
    return found.select(F.shiftright("ref", ANCHOR).cast("int").alias("part"), F.expr(f"cast(ref & {(1 << ANCHOR) - 1} as int)").alias("number"))


def _wanted(part: Part, replied: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Anchors to look at: hash repeated in the part, replied, or of a hot gram."""
    chosen = part.times > 1
    chosen[replied] = True
    return chosen[part.of]


def _hot_anchors(part: Part, hot: np.ndarray) -> np.ndarray:
    out, first = np.zeros(len(part.doc), bool), 0
    for data, _, at, _ in part.found if len(hot) else ():
        grams = np.ascontiguousarray(data[at[:, None] + np.arange(GRAM)]).view(f"S{GRAM}").reshape(-1) if len(at) else np.zeros(0, f"S{GRAM}")
        out[first : first + len(at)] = np.isin(grams, hot)
        first += len(at)
    return out


def suffixes(dealt: DataFrame, shared: DataFrame, sent, hot_sent) -> DataFrame:
    """Step 3: (bucket, s, id, ref) of each class, or of each string of a hot gram."""

    def find(docs: pa.Table, found: pa.Table) -> pa.Table:
        splitters, hot = sent.value, hot_sent.value
        out = [np.zeros((0, LENGTH + LEFT + 2), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if docs.num_rows:
            part, number = Part(docs), docs["part"][0].as_py()
            wanted = _wanted(part, found["number"].to_numpy() if found.num_rows else np.zeros(0, np.int64), hot) | _hot_anchors(part, hot)
            held = Classes(part, wanted, hot)
            plain = held.first[~held.hot]
            out[0].append(np.column_stack([held.right[plain], held.left[plain], held.least[plain].astype(np.uint8), held.most[plain].astype(np.uint8)]))
            out[1].append(held.smallest[~held.hot])
            out[2].append(held.anchor[plain] << 6)
            text, of, which, o = held.strings()
            if len(text):
                smallest, first = firsts(of, held.smallest[which])
                out[0].append(np.concatenate([text[first], np.zeros((len(first), LEFT + 2), np.uint8)], axis=1))
                out[1].append(smallest)
                out[2].append((held.anchor[held.first[which[first]]] << 6) + o[first] + 1)
            ref = (np.int64(number) << (ANCHOR + 6)) + np.concatenate(out[2])
        else:
            ref = np.zeros(0, np.int64)
        rows, ids = np.concatenate(out[0]), np.concatenate(out[1])
        bucket = np.searchsorted(splitters, np.ascontiguousarray(rows[:, :LENGTH]).view(f"S{LENGTH}").reshape(-1), "right")
        data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())
        return pa.table([pa.array(bucket.astype(np.int32)), data, pa.array(ids), pa.array(ref)], names=["bucket", "s", "id", "ref"])

    return dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(find, "bucket int, s binary, id bigint, ref bigint")


def repeats(rows: DataFrame, ranges: int) -> DataFrame:
    """Step 4 on each bucket: (part, ref, bits) of the classes and strings that occur with a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b"".join(b.column(0).to_pylist()), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        data, ids, ref = zip(*held)
        data = np.frombuffer(b"".join(data), np.uint8).reshape(-1, LENGTH + LEFT + 2)
        ids, ref = np.concatenate(ids), np.concatenate(ref)
        del held
        bits = repeated_starts(ids, data[:, -2].astype(np.int64), data[:, -1].astype(np.int64), data[:, :LENGTH], data[:, LENGTH : LENGTH + LEFT])
        hit = bits > 0
        part, own = ref[hit] >> (ANCHOR + 6), ref[hit] & ((1 << (ANCHOR + 6)) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(own), pa.array(bits[hit].view(np.int64))], names=["part", "ref", "bits"])

    return rows.repartitionById(ranges, "bucket").select("s", "id", "ref").mapInArrow(freeing(run), "part int, ref bigint, bits bigint")


def covered(starts: np.ndarray, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bytes of joined texts the repeated strings cover; ``starts`` has the end of the last text too, ``at`` are places in the whole."""
    begins = np.zeros(starts[-1] + LENGTH, np.int32)
    for o in range(LEFT + 1):
        begins[at[(bits >> np.uint64(o) & np.uint64(1)).astype(bool)] - o + LENGTH] = 1  # no two anchors have one string
    so_far = np.cumsum(begins, dtype=np.int32)
    return so_far[LENGTH:] > so_far[:-LENGTH]  # a string starts here or up to 49 bytes before; none crosses the end of its text


def repeated_in(part: Part, refs: np.ndarray, replied: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step 6: (text, place, bits) of the anchors of a part, from what the buckets replied."""
    of_string = refs & 63 > 0
    wanted = _wanted(part, np.zeros(0, np.int64), hot) | _hot_anchors(part, hot)
    wanted[refs >> 6] = True
    held = Classes(part, wanted, hot)
    bits = np.zeros(len(held.first), np.uint64)
    plain = dict(zip((refs[~of_string] >> 6).tolist(), replied[~of_string].tolist()))
    own = held.anchor[held.first].tolist()
    bits[:] = [plain.get(a, 0) for a in own]
    text, of, which, o = held.strings()
    if len(text):
        bits[held.hot] = 0
        smallest, first = firsts(of, held.smallest[which])
        named = set(refs[of_string].tolist())
        anywhere = np.array([x in named for x in ((held.anchor[held.first[which[first]]] << 6) + o[first] + 1).tolist()], bool)
        repeated = anywhere[of] | (held.smallest[which] > smallest[of])
        np.bitwise_or.at(bits, which[repeated], np.uint64(1) << o[repeated].astype(np.uint64))
    every = (np.uint64(2) << held.most.astype(np.uint64)) - (np.uint64(1) << held.least.astype(np.uint64))
    found = np.where(held.id > held.smallest[held.number], every, bits[held.number])
    hit = found > 0
    return held.doc[hit], held.place[hit], found[hit]


def splitters_of(rows: DataFrame, n: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters between buckets, and the grams that are compared by whole strings."""

    def sampler():
        seen: set[bytes] = set()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            texts = [t for t in batch.column(0).cast(pa.binary()).to_pylist() if not ((key := hashlib.blake2b(t, digest_size=16).digest()) in seen or seen.add(key))]
            data, _, at, h = anchors(texts)
            at = at[np.random.default_rng(len(at)).random(len(at)) < 1 / 16]
            data = np.concatenate([data, np.zeros(LENGTH, np.uint8)])[at[:, None] + np.arange(LENGTH)]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in data], pa.binary())], names=["value"])

        return one

    step = max(1, n // max(2000, ranges * SAMPLES // 10))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select("text")
    values = sorted(r["value"] for r in map_batches(sample, sampler, "value binary").collect())
    if not values:
        return np.zeros(0, f"S{LENGTH}"), np.zeros(0, f"S{GRAM}")
    grams, counts = np.unique(np.array([v[:GRAM] for v in values], f"S{GRAM}"), return_counts=True)
    hot = grams[counts > max(8.0, HOT * len(values) / ranges)]
    marks = [values[k] for k in np.linspace(0, len(values) - 1, ranges + 1).astype(int)[1:-1]]
    hot_set = set(hot.tolist())
    marks = {v if v[:GRAM].rstrip(b"\0") in hot_set else v[:GRAM] for v in marks}
    return np.array(sorted(marks), f"S{LENGTH}"), hot


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; ``kept`` holds the bytes that stay."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total, n = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    total = total or 0
    parts, buckets, ranges = (max(12, -(-total // size)) for size in (PART, HASH_BUCKET, SUFFIX_BUCKET))
    bits = min(63, max(32, (total // 16).bit_length() + 12))
    splitters, hot = splitters_of(rows, n, ranges)
    sent, hot_sent = spark.sparkContext.broadcast(splitters), spark.sparkContext.broadcast(hot)

    dealt = dealt_texts(rows, parts)
    shared = shared_hashes(anchor_hashes(dealt, bits), buckets)
    marks = repeats(suffixes(dealt, shared, sent, hot_sent), len(splitters) + 1)
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    nothing = hashlib.sha256(b"").hexdigest()

    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs.num_rows:
            part = Part(docs)
            refs, replied = (found["ref"].to_numpy(), found["bits"].to_numpy().view(np.uint64)) if found.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            of, place, marked = repeated_in(part, refs, replied, hot_sent.value)
            starts = np.cumsum([0, *(len(t) for t in part.texts)])
            gone_at = covered(starts, starts[of] + place, marked)
            hit = np.zeros(len(part.texts), bool)
            hit[of] = True
            for k, (text, own) in enumerate(zip(part.texts, part.rows)):
                removed, spans, kept = 0, 0, text
                if hit[k]:
                    gone = gone_at[starts[k] : starts[k + 1]]
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                stays = (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept)
                for ident, times in own:
                    out += [(ident, *(stays if ident == part.ids[k] else (len(text), len(text), 1, nothing, b"")))] * times
            for key, ident, size, text in zip(*(docs[c].to_pylist() for c in ("key", "id", "n", "text"))):
                if key is None:
                    out.append((ident, size, size, 1, nothing, b"") if text is None else (ident, size, 0, 0, hashlib.sha256(text).hexdigest(), text))
        columns = list(zip(*out)) if out else [()] * len(names)
        columns[0] = [None if x == NO_ID else x for x in columns[0]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return dealt.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(cut, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
