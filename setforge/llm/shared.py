"""What the operators of this subpackage share: stored tables, Arrow plumbing, words.

Lineage is cut by writing Parquet into the folder that the cluster names in
``spark.checkpoint.dir``.  Where that is unset, a temporary folder serves, and
only for a local master, because no other machine could see it.  Results of
operators are lazy and read these tables, so operators free only what their
result does not need; callers free the rest with ``freed_shelves``.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP = 16 << 20
_local_folder: list[str] = []
#: Folders of the shelves in use, oldest first.
_shelves: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="setforge-"))
        atexit.register(shutil.rmtree, _local_folder[0], True)
    return f"file://{_local_folder[0]}"


class Shelf:
    """Tables one call of an operator writes to the shared folder and reads again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _shelves.append((spark, self.root))

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # a task holds a row group of each file it writes
        df.write.mode("overwrite").option("parquet.block.size", str(ROW_GROUP)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Free tables that no DataFrame still to be run reads."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freed_shelves() -> Iterator[None]:
    """Delete what operators store inside the block when it ends; their results must have been written elsewhere by then."""
    before = len(_shelves)
    try:
        yield
    finally:
        for spark, root in _shelves[before:]:
            _delete(spark, root)
        del _shelves[before:]


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches that suit rows of some kilobytes of text; the defaults suit narrow rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with a state per task: ``make()`` gives the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows and (out := one(batch)) is not None:
                yield out

    return df.mapInArrow(freeing(run), schema)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker, which Spark keeps, gives free memory back to the machine."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


#: Lower-cases A-Z and blanks every ASCII byte that is neither a digit nor a letter.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 57 < b < 97 or 122 < b < 128 else b for b in range(256))


def plain_words(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of digits, letters and non-ASCII characters, A-Z lowered, from pieces of about ``size`` bytes of a text of any length."""
    start = 0
    while start < len(text):
        piece = text[start : start + size].translate(WORD_BYTES)
        start += len(piece)
        # on to the end of the word that the piece cuts
        while start < len(text) and not piece.endswith(b" "):
            more = text[start : start + 4096].translate(WORD_BYTES)
            stop = more.find(b" ") + 1 or len(more)
            piece, start = piece + more[:stop], start + stop
        if words := piece.split():
            yield words
