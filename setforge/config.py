"""Sketch configurations: immutable parameters, validated on creation."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
from typing import Protocol


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Registers:
    """What all register families share: m registers in 0 .. q+1 of base b, points of rate a."""

    m: int = 256
    b: float = 2.0
    q: int = 62
    a: float = 20.0
    scheme: str = "xxhash64"
    range_correction: bool = field(default=False)
    name = "registers"

    def __post_init__(self) -> None:
        _need(self.m > 0, "m must be positive")
        _need(self.b > 1, "b must exceed 1")
        _need(self.q >= 0, "q must not be negative")
        _need(self.a > 0, "a must be positive")
        _need(self.scheme in ("xxhash64", "md5", "marked"), "scheme must be xxhash64, md5 or marked")

    @property
    def log_b(self) -> float:
        return math.log(self.b)

    @property
    def rate(self) -> float:
        """The rate in the estimators; 1/m where an element updates one register."""
        return self.a

    def info(self) -> dict[str, str]:
        """Parameters as text, for metadata lines."""
        return {"name": self.name} | {k: repr(v) for k, v in asdict(self).items()}


@dataclass(frozen=True)
class GeneralizedHyperLogLog(Registers):
    range_correction: bool = True
    name = "GHLL"

    @property
    def rate(self) -> float:
        return 1 / self.m


@dataclass(frozen=True)
class HyperLogLog(GeneralizedHyperLogLog):
    name = "HyperLogLog"

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.m & (self.m - 1) == 0, "m must be a power of two")
        _need(self.b == 2, "b must be 2")
        _need(self.p + self.q <= 64, "p + q must not exceed 64")

    @property
    def p(self) -> int:
        return self.m.bit_length() - 1


@dataclass(frozen=True)
class SetSketch1(Registers):
    name = "SetSketch1"


@dataclass(frozen=True)
class SetSketch2(Registers):
    name = "SetSketch2"


@dataclass(frozen=True)
class MinHash:
    m: int = 256
    scheme: str = "xxhash64"
    name = "MinHash"
    #: Hash values are below this.
    span = 1 << 60

    def __post_init__(self) -> None:
        _need(self.m > 0, "m must be positive")
        _need(self.scheme in ("xxhash64", "md5"), "scheme must be xxhash64 or md5")

    def info(self) -> dict[str, str]:
        return {"name": self.name} | {k: repr(v) for k, v in asdict(self).items()}


@dataclass(frozen=True)
class HyperMinHash:
    bucket_bits: int = 12
    bucket_size: int = 6
    sub_bits: int = 10
    scheme: str = "xxhash64"
    name = "HyperMinHash"

    def __post_init__(self) -> None:
        _need(self.scheme in ("xxhash64", "md5", "marked"), "scheme must be xxhash64, md5 or marked")
        _need(0 < self.bucket_bits <= 16, "bucket_bits must be in 1 .. 16")
        _need(0 < self.bucket_size <= 6, "bucket_size must be in 1 .. 6")
        _need(0 <= self.sub_bits <= 20, "sub_bits must be in 0 .. 20")
        _need(self.bucket_size + 1 + self.sub_bits <= 32, "a register must fit 32 bits")

    @property
    def m(self) -> int:
        return 1 << self.bucket_bits

    @property
    def effective_base(self) -> float:
        return 2.0 ** (2.0**-self.sub_bits)

    def as_ghll(self) -> GeneralizedHyperLogLog:
        steps = ((1 << self.bucket_size) - 1) << self.sub_bits
        return GeneralizedHyperLogLog(self.m, self.effective_base, steps, scheme=self.scheme)

    def as_hll(self) -> HyperLogLog:
        return HyperLogLog(self.m, 2.0, min((1 << self.bucket_size) - 1, 64 - self.bucket_bits), scheme=self.scheme)

    def info(self) -> dict[str, str]:
        return {"name": self.name} | {k: repr(v) for k, v in asdict(self).items()}


class SketchFamily(Protocol):
    """The least a configuration has; ``setforge.operators.families`` says what more it may answer."""

    name: str

    @property
    def m(self) -> int: ...

    def info(self) -> dict[str, str]: ...


def same(first: SketchFamily, second: SketchFamily) -> None:
    """Only sketches of equal configuration may be merged or compared."""
    _need(first == second, f"configurations differ: {first} and {second}")
