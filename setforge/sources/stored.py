"""Tables that an operator writes and reads again, so that what follows sees one and the same partitioning.

They go to the folder that the cluster names in ``spark.checkpoint.dir``.  Where
that is unset, a temporary folder serves, and only for a local master, because no
other machine could see it; it is deleted when the process ends.  Results of
operators are lazy and read these tables; callers free them with ``freed`` once
results are written elsewhere.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
#: Folders in use, oldest first.
_held: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="setforge-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which ``freed`` deletes."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _held.append((spark, folder))
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freed() -> Iterator[None]:
    """Delete what operators store inside the block when it ends; their results must have been written elsewhere by then."""
    before = len(_held)
    try:
        yield
    finally:
        for spark, folder in _held[before:]:
            delete(spark, folder)
        del _held[before:]
