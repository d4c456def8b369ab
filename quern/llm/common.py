"""What the training-data operators share: reading tables, scratch tables, folds."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of fixed size that a broadcast may have.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, as the contracts ask."""
    return F.translate(c, UPPER, LOWER)


def mark(docs: DataFrame) -> Column:
    """64-bit hash of a row's text, null as empty."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


class Scope:
    """The scratch tables of one run; see scratch_scope()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def delete(self) -> None:
        """Removes the tables. Frames that read them must have been used."""
        while self.paths:
            path, files = _file_system(self.spark, self.paths.pop())
            files.delete(path, True)


_scope: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables materialized within belong to the scope given and to no other run: its owner deletes them once their
    readers are done. Tables outside of any scope are deleted when the application ends."""
    scope = Scope(spark)
    token = _scope.set(scope)
    try:
        yield scope
    finally:
        _scope.reset(token)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. A folder of this machine only where that is unset and driver and
    executors are one process (tests); elsewhere an unset folder is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{tempfile.gettempdir()}/quern-checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, of the scope if there is one; it goes when the application ends at the latest."""
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.paths.append(path)
    where, files = _file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later steps survive lost executors."""
    path = f"{scratch_path(spark, name)}/rows"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if a count finds that it has so many rows at most. For materialized rows of fixed size."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, mark) aren't in gone; of rows alike in a (doc_id, mark) of repeated one stays.

    Both frames have columns d, m, are distinct and materialized. Texts move only where gone is too long to broadcast,
    or for the rows that repeat.
    """
    names = docs.columns
    own = docs.withColumn("__q_d", docs["doc_id"].cast("long")).withColumn("__q_m", mark(docs))
    on = lambda keys: F.col("__q_d").eqNullSafe(keys["d"]) & (F.col("__q_m") == keys["m"])
    left = own.join(small(gone), on(gone), "left_anti")
    if not repeated.limit(1).count():
        return left.select(*names)
    twice = small(repeated)
    once = left.join(twice, on(repeated), "left_semi").dropDuplicates(["__q_d", "__q_m"])
    return left.join(twice, on(repeated), "left_anti").unionByName(once).select(*names)


@contextlib.contextmanager
def lean_memory() -> Iterator[None]:
    """For a task of a Python worker: large arrays are freed to the system at once, and at the end all that is unused is,
    as workers outlive their tasks and share an executor's memory with other operators' workers."""
    libc = None
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError):
            libc.malloc_trim(0)


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, for mapInArrow, within lean_memory()."""

    def lean_run(batches: Batches) -> Batches:
        with lean_memory():
            yield from run(batches)

    return lean_run


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def size_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
