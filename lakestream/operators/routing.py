"""Target tables of a record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route_by_field(df: DataFrame, field: str, target: str = "target") -> DataFrame:
    """Target = lower-cased value of a field; records without one have a null target and go nowhere."""
    return df.withColumn(target, F.lower(F.col(field)))


def fan_out(df: DataFrame, tables: Sequence[str], target: str = "target") -> DataFrame:
    """Every record goes to each listed table."""
    if not tables:
        raise ValueError("no target tables")
    return df.withColumn(target, F.explode(F.array(*[F.lit(t.lower()) for t in tables])))
