"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are cut at these six ASCII characters, as ``bytes.split()`` does.
ASCII_SPACE = "\\x20\\x09-\\x0D"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master may go without that setting: it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{(_run_folder.get() or base).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The folder of the run that is open in this thread, if any.
_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


@contextmanager
def working_tables(spark: SparkSession, name: str) -> Iterator[str]:
    """While it is open, tables that cut lineage go below one new folder, which is removed at the end, also after an error.

    For jobs that write their result elsewhere before the end: a DataFrame made inside and read only afterwards has lost its
    tables. Paths are taken by the driver's thread, so other threads and runs keep their own. Runs may be nested.
    """
    folder = shared_path(spark, name)
    before = _run_folder.set(folder)
    try:
        yield folder
    finally:
        _run_folder.reset(before)
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own_name(key: str, results: Iterable[str]) -> str:
    """``key``, which must not have the name of a result."""
    if key in set(results):
        raise ValueError(f"the key {key!r} has the name of a result: rename it")
    return key


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage is cut there, its size is known."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of more rows is not broadcast.
BROADCAST_ROWS = 300_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join, given how many rows it may have: beyond ``BROADCAST_ROWS`` the join is by sorting. Spark goes by the bytes of
    compressed files, and does not count rows that an explode adds, so a table that it takes for small can fill the driver.
    """
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def give_back() -> None:
    """At the end of a task: gives freed memory back to the system, as idle Python workers would hold it while others work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(sizes, most: int):
    """Ranges of neighbouring rows whose sizes add up to ``most`` at most (one row may be larger)."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)
