"""Cutting lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A folder of this machine is used, and set as checkpoint folder, only where
    the session names none and runs on this machine alone, as in tests.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "cellweave-checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_begun: set[str] = set()


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def run_dir(spark: SparkSession) -> str:
    """The folder of this session's tables; it goes when the session's JVM ends."""
    folder = f"{shared_dir(spark)}/cellweave/{spark.sparkContext.applicationId}"
    if folder not in _begun:
        fs, path = _hadoop(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _begun.add(folder)
    return folder


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that this session has saved; DataFrames that read them cannot be used any more."""
    fs, path = _hadoop(spark, run_dir(spark))
    fs.delete(path, True)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one file through Spark's file systems, from the driver."""
    fs, where = _hadoop(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


_scratch: list[list[str]] = []


def _stored(df: DataFrame, name: str, kept: bool) -> DataFrame:
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _scratch and not kept:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a parquet table in the shared folder, read back.

    Cuts lineage: what follows reads files that outlive any executor, and joins
    on the result are plain exchanges, which adaptive execution can split. The
    table stays until the session ends or ``cleanup`` is called, or the
    ``scratch`` around it ends.
    """
    return _stored(df, name, False)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables saved inside are deleted at the end, but for those saved by the function that this gives.

    For work that is done inside: what that function saves has been written by
    then and reads none of the others.
    """
    _scratch.append([])
    try:
        yield lambda df, name: _stored(df, name, True)
    finally:
        for path in _scratch.pop():
            fs, where = _hadoop(spark, path)
            fs.delete(where, True)
