"""What the operators of this subpackage share: tables, words and Python tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.sources.shared import folder as shared_dir
from veilspark.sources.shared import scratch, written

__all__ = ["held_bytes", "joinable", "python_task", "release", "scratch", "shared_dir", "shuffle_partitions", "small_batches", "table", "word_hashes", "words_of", "written"]

#: One letter case and one splitting rule for words: A-Z lower-cased, split at space and \x09-\x0D.
#: bytes.lower() and bytes.split() follow exactly these two rules on UTF-8.


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """Words of a whole text as UTF-8 bytes; null has none."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_bytes(c: Column, kind: T.DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, (held_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, (T.ArrayType, T.MapType)):
        parts = [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.keyType, kind.valueType]
        if all(isinstance(x, T.AtomicType) and not isinstance(x, (T.StringType, T.BinaryType)) for x in parts):
            return F.coalesce(F.size(c), F.lit(0)).cast("long") * 16 * len(parts) + 24
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)).cast("long") + 24
    return F.lit(16).cast("long")


def joinable(small: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """``small`` marked for broadcast if what it holds, measured, is below ``limit``; otherwise as it is, for a shuffled join."""
    size = small.agg(F.sum(reduce(lambda a, b: a + b, (held_bytes(F.col(f"`{f.name}`"), f.dataType) for f in small.schema.fields)))).first()[0]
    return F.broadcast(small) if (size or 0) <= limit else small


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for shuffles whose rows grow after them and must not be merged."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession, rows: int = 500, size: str = "4m") -> None:
    """Arrow batches of few rows and bytes, as texts may be long. Lowers the session's settings, never raises them; they
    stay lowered, since they are read when a plan runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "-1", "67108864", "67108864b", "64MB"):
        spark.conf.set(key, size)


def release() -> None:
    """Gives the memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def python_task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow. At the end of each task freed memory goes back: workers live on, and beside them the engine
    and the stages that follow need it."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task
