"""What operators ask of a family of sketches, dispatched by the type of its configuration.

Each question is a generic function; the library's own families answer it where
their code lives.  A family from elsewhere needs no change here: without an answer
registered for its type, the configuration itself is asked.  The least it has is

* ``m`` registers and ``points(rows, element, keys)``, rows (keys..., reg, k);

and it may have

* ``keeps``: ``"max"`` (if left out) or ``"min"`` of a register's points;
* ``empty``: what an untouched register stands for, 0 if left out;
* ``bits``: how many a packed register takes;
* ``estimators()``: label to ``f(cfg, sketches, keys)``, each giving (keys..., estimate);
* ``joint_estimators()``: label to ``f(cfg, compared)``, each giving (k1, k2, n1, n2, q).

``updates.register(kind)`` and the like answer for a type that cannot be changed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import singledispatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Estimator = Callable[..., DataFrame]


@singledispatch
def updates(cfg, df: DataFrame, element: str, keys: list[str], limit: Column | None = None) -> DataFrame:
    """(keys..., reg, k) for every update; null elements give none."""
    if limit is not None:
        raise ValueError(f"{type(cfg).__name__} has no bulk insertion")
    return cfg.points(df.where(F.col(element).isNotNull()).select(*keys, element), element, keys).select(*keys, "reg", "k")


@singledispatch
def keeps(cfg) -> str:
    """Whether a register keeps its largest or its smallest point."""
    return getattr(cfg, "keeps", "max")


@singledispatch
def empty(cfg) -> int:
    """The value of a register that nothing touched."""
    return getattr(cfg, "empty", 0)


@singledispatch
def width(cfg) -> int:
    """Bits of a packed register."""
    return cfg.bits


@singledispatch
def estimators(cfg) -> dict[str, Estimator]:
    """Cardinality estimators by label; joint quantities rest on the first one."""
    return cfg.estimators()


@singledispatch
def joint_estimators(cfg) -> dict[str, Estimator]:
    """Joint estimators by label, besides inclusion and exclusion."""
    return getattr(cfg, "joint_estimators", dict)()


@singledispatch
def kernel(cfg, limit: float | None = None):
    """A register block for Arrow kernels."""
    raise ValueError(f"no kernel for {type(cfg).__name__}")


@singledispatch
def by_kernel(cfg) -> bool:
    """Whether sketches are built by Arrow kernels unless asked otherwise."""
    return False


def best(cfg) -> Column:
    """The aggregate that builds and merges."""
    return (F.min("k") if keeps(cfg) == "min" else F.max("k")).alias("k")
