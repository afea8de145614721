"""Streams of random bits that read on from one hash into the next, and whole numbers drawn from them without bias.

The stream of an element is the row of its hashes' bits, 60 a hash, high bits
first; a read is given by its place in the stream, so nothing has state.  Rejection
is a state that runs over a bounded number of further bits or words, with a defined
end for the draws, fewer than one in 2^60, that are still open then.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from setforge.functions.hashing import bits

WORD = 60
#: Further bits of a draw by halves, and words of a draw by products.
MORE_BITS, MORE_WORDS = 120, 60


def word(scheme: str, x: Column, number: Column | int) -> Column:
    """Word ``number`` of an element's stream, from 0."""
    return bits(scheme, x, number, 1, 15)


def read(scheme: str, x: Column, at: Column | int, n: Column | int) -> Column:
    """``n`` (1 to 64) bits from place ``at``, as many as there are hashes needed; 64 bits fill the sign as well."""
    if isinstance(n, int) and not 1 <= n <= 64:
        raise ValueError("1 to 64 bits can be read at once")
    at = (F.lit(at) if isinstance(at, int) else at).cast("int")
    first, skip = F.floor(at / WORD).cast("int"), F.pmod(at, F.lit(WORD))
    most = (WORD - 1 + (n if isinstance(n, int) else 64) + WORD - 1) // WORD  # words that a read can touch
    n = F.lit(n) if isinstance(n, int) else n.cast("int")

    def joined(value: Column, i: int) -> Column:
        """``value`` with the next word's bits, or as many of them as are still wanted."""
        kept = F.least(F.lit(WORD), skip + n - i * WORD)
        w = _right(word(scheme, x, first + i), F.lit(WORD) - kept)
        return F.when(kept > 0, _left(value, kept).bitwiseOR(w)).otherwise(value)

    # the first word without the bits before the read, and without those behind it
    found = _right(word(scheme, x, first).bitwiseAND(_left(F.lit(1).cast("bigint"), F.lit(WORD) - skip) - 1), F.greatest(F.lit(0), F.lit(WORD) - n - skip))
    for i in range(1, most):
        found = joined(found, i)
    return found


def _left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by.cast("int"))


def _right(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by.cast("int"))


def bit(scheme: str, x: Column, at: Column | int) -> Column:
    """One bit from place ``at``."""
    at = F.lit(at) if isinstance(at, int) else at
    w = word(scheme, x, F.floor(at / WORD).cast("int"))
    return _right(w, F.lit(WORD - 1) - F.pmod(at, F.lit(WORD))).bitwiseAND(F.lit(1))


def uniform_by_halves(scheme: str, x: Column, at: int, n: int) -> Column:
    """Uniform in 0 .. n-1 (n up to 2^31) by Lumbroso's method, which wastes few bits.

    A draw is uniform below some v; once v reaches n, a value below n is the result,
    and any other leaves a uniform value below v - n to go on with, a bit at a time.
    """
    if not 1 <= n <= 1 << 31:
        raise ValueError("n must be in 1 .. 2^31")
    if n == 1:
        return F.lit(0).cast("bigint")
    first = (n - 1).bit_length()
    start = read(scheme, x, at, first)
    rest = (1 << first) - n
    state = F.struct((start < n).alias("done"), F.when(start < n, start).otherwise(start - n).alias("c"), F.lit(rest).cast("bigint").alias("v"))

    def tossed(s: Column, i: Column) -> Column:
        c, v = s["c"] * 2 + bit(scheme, x, i), s["v"] * 2
        fits = (v >= n) & (c < n)
        over = (v >= n) & ~fits
        return F.when(s["done"], s).otherwise(F.struct(fits.alias("done"), F.when(over, c - n).otherwise(c).alias("c"), F.when(over, v - n).otherwise(v).alias("v")))

    # an open draw ends as c in 0 .. v-1 does, which is below n
    places = F.sequence(F.lit(at + first), F.lit(at + first + MORE_BITS - 1))
    return F.aggregate(places, state, tossed, lambda s: s["c"])


def uniform_by_product(scheme: str, x: Column, at: int, n: int) -> Column:
    """Uniform in 0 .. n-1 (n up to 2^31) by Lemire's method: the upper half of 32 bits times n, unless the lower half is one of those that are too many."""
    if not 1 <= n <= 1 << 31:
        raise ValueError("n must be in 1 .. 2^31")
    least, low = (-n) % (1 << 32) % n, F.lit((1 << 32) - 1)

    def tried(s: Column, i: Column) -> Column:
        m = read(scheme, x, F.lit(at) + i * 32, 32) * F.lit(n).cast("bigint")
        return F.when(s["done"], s).otherwise(F.struct((m.bitwiseAND(low) >= least).alias("done"), _right(m, F.lit(32)).alias("v")))

    # only powers of two never reject; the last word counts whatever it is
    tries = 1 if least == 0 else MORE_WORDS
    state = F.struct(F.lit(False).alias("done"), F.lit(0).cast("bigint").alias("v"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), state, tried, lambda s: s["v"])
