"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_open = threading.local()


def one_process(spark: SparkSession) -> bool:
    """Do driver and executors share a process, and so memory and disk?"""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def folder(spark: SparkSession, what: str) -> str:
    """The name of a new folder below spark.checkpoint.dir. Where that is unset, a session on one machine gets a folder of
    its own; on a cluster that is an error, as a folder of one machine is not seen by the others."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        _made.append(base)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    (_open.scopes[-1] if getattr(_open, "scopes", None) else _made).append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows from a table in the shared folder: lineage ends there, and any executor can reread it."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Folders named inside are deleted at the end, but those put into the list, which last as long as the session."""
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    mine, kept = [], []
    _open.scopes.append(mine)
    try:
        yield kept
    finally:
        _open.scopes.pop()
        (_open.scopes[-1] if _open.scopes else _made).extend(p for p in mine if p in kept)
        delete(spark, [p for p in mine if p not in kept])


def delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        name = hadoop.Path(path)
        name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


def cleanup() -> None:
    """Deletes what this process has left in the shared folder. DataFrames that read it end with that; runs at exit too."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        delete(spark, _made)
        _made.clear()


@atexit.register
def _at_exit() -> None:
    try:
        cleanup()
    except Exception:  # the engine may be gone already
        pass
