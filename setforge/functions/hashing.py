"""Hash columns in two schemes: xxhash64 for speed, md5 to be checked in any database.

All hashes have at most 60 bits, so that ANSI arithmetic on them cannot overflow.
Each element gives as many independent hashes as asked for, one for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _salted(x: Column, salt: Column | int | None) -> Column:
    text = x.cast("string")
    return text if salt is None else F.concat(text, F.lit("|"), (F.lit(salt) if isinstance(salt, int) else salt).cast("string"))


def _hex(digest: Column, start: int, size: int) -> Column:
    return F.conv(F.substring(digest, start, size), 16, 10).cast("bigint")


def bits(scheme: str, x: Column, salt: Column | int | None, start: int, size: int) -> Column:
    """``4 * size`` bits of the hash, from hexadecimal digit ``start`` (1 is the first; size up to 15).

    In the scheme ``word``, ``x`` is such a hash of 60 bits itself, so that many draws of an element cost one hash.
    """
    if scheme == "word":
        if start != 1 or size > 15:
            raise ValueError("a word has the first 15 digits, which are read from the first one")
        return F.shiftrightunsigned(x, 60 - 4 * size)
    if scheme == "md5":
        return _hex(F.md5(_salted(x, salt)), start, size)
    other = F.lit(-1) if salt is None else (F.lit(salt) if isinstance(salt, int) else salt)
    word = F.xxhash64(x.cast("string"), other.cast("bigint"), F.lit((start - 1) // 15))
    return F.shiftrightunsigned(word, 64 - 4 * size)


def unit(scheme: str, x: Column, salt: Column | int | None, start: int = 9, size: int = 13) -> Column:
    """A number in (0, 1) of ``4 * size`` bits."""
    return (bits(scheme, x, salt, start, size) + F.lit(0.5)) / F.lit(float(16**size))
