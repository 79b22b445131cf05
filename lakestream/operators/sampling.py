"""Weighted samples without replacement, by stratum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a hash: the same for a key on every run and layout."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def weighted_sample(df: DataFrame, strata: Sequence[str], key: str, weight: str, k: int, seed: int = 0) -> DataFrame:
    """The sample of ``k`` rows per stratum, all of a smaller one, with their ``draw`` from 1.

    A row waits an exponential time with its weight as rate, and the first ``k`` are drawn: that is drawing
    one after the other in proportion to weight, without replacement. Each task sends at most ``k`` rows per stratum to the
    shuffle. Rows without a key or a positive weight are never drawn; a null stratum is a stratum.
    """
    wait = -F.log(hashed_uniform(F.col(key), seed)) / F.col(weight)
    order = Window.partitionBy(*strata).orderBy("_wait", key)
    waiting = df.filter((F.col(weight) > 0) & F.col(key).isNotNull()).withColumn("_wait", wait)
    return waiting.withColumn("draw", F.row_number().over(order)).filter(F.col("draw") <= k).drop("_wait")
