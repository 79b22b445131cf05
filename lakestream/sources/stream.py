"""Rate-limited file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Change-capture batch size, queue size and poll interval.
DEFAULT_BATCH_ROWS = 2048
DEFAULT_QUEUE_ROWS = 8192
DEFAULT_POLL_MS = 1000


def check_rate(batch_rows: int = DEFAULT_BATCH_ROWS, queue_rows: int = DEFAULT_QUEUE_ROWS, poll_ms: int = DEFAULT_POLL_MS):
    """Limits a source may be given."""
    if batch_rows < 1:
        raise ValueError("batch size must be at least 1")
    if queue_rows < 1:
        raise ValueError("queue size must be at least 1")
    if poll_ms < 0:
        raise ValueError("poll interval cannot be negative")


def stage_files(df: DataFrame, path: str, order: str | list[str], files: int | None = None) -> None:
    """Write rows as files ranged by ``order``, the replay form of a topic."""
    spark = df.sparkSession
    files = files or max(8, spark.sparkContext.defaultParallelism)
    df.repartitionByRange(files, *([order] if isinstance(order, str) else order)).write.mode("append").parquet(path)


def stream_source(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None, bounded: bool = True
) -> DataFrame:
    """Stream a folder of Parquet files, a bounded number of files per micro-batch, or all there is if not ``bounded``.

    The default takes a quarter of the session's parallelism at least two files at a time, so the number of
    micro-batches stays the same when :func:`stage_files` writes more files on a larger cluster.
    """
    if not bounded:
        return spark.readStream.schema(schema).parquet(path)
    if files_per_trigger is None:
        files_per_trigger = max(2, spark.sparkContext.defaultParallelism // 4)
    check_rate(batch_rows=files_per_trigger)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
