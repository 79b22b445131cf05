"""The state of a stopped job, read from its checkpoint as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators of a checkpoint, their stores and the batches that can be read."""
    return spark.read.format("state-metadata").load(checkpoint)


def state_rows(
    spark: SparkSession, checkpoint: str, batch: int | None = None, operator: int = 0, store: str | None = None
) -> DataFrame:
    """Keys and values an operator holds after ``batch`` (the last one without), a row per key, a task per store.

    Columns of key and value stand side by side; where both have a name, the value's gets ``value_`` before it.
    """
    reader = spark.read.format("statestore").option("operatorId", operator)
    if batch is not None:
        reader = reader.option("batchId", batch)
    if store is not None:
        reader = reader.option("storeName", store)
    rows = reader.load(checkpoint)
    keys = rows.schema["key"].dataType.names
    values = rows.schema["value"].dataType.names
    return rows.select(
        *[rows["key"][k].alias(k) for k in keys],
        *[rows["value"][v].alias(f"value_{v}" if v in keys else v) for v in values],
    )
