"""Masking of streams: the batch masks, row by row, in a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.mask import mask


def mask_stream(stream: DataFrame, rules: dict[str, str]) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return mask(stream, rules)


def write_masked(stream: DataFrame, rules: dict[str, str], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the masked rows to a Parquet folder, exactly once by the checkpoint."""
    return mask_stream(stream, rules).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
