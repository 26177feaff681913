"""What the text operators share: tables, batch reading, joins on hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import saved, shared_dir

__all__ = ["batches_of", "hot_join", "pieces_of", "release", "saved", "shared_dir", "table", "thrifty", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces_of(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``limit`` bytes at most.

    A longer text comes alone and whole.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8 bytes; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs inside send at most ``rows`` rows a batch to Python: whole texts are large. The setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hot_join(big: DataFrame, small: DataFrame, on: list[str], n: str, total: int, share: int = 1000) -> DataFrame:
    """``big`` joined with ``small`` on ``on``, where ``n`` of ``small`` counts the rows of ``big`` (``total`` in all) with its key.

    Keys that hold more than one row in ``share`` of ``big`` are ``share`` at
    most; theirs go by broadcast, so that no task gathers a hot key.
    """
    often = F.col(n) * share > total
    hot = small.filter(often)
    many = big.join(F.broadcast(hot), on)
    rest = big.join(F.broadcast(hot.select(*on).distinct()), on, "left_anti")
    return rest.join(small.filter(~often), on).unionByName(many)


def release() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives memory back when its task ends: workers outlive tasks and serve other stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
