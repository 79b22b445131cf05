"""Distinct counts and quantiles that are stored per day and merged for any range of days.

Sketches are estimates of a fixed size; bitmaps are exact, for whole-number ids. Either is built once from the rows, and
every coarser level is made from the stored parts, never from the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the distinct-count sketch (base 2 logarithm of its registers) and of the quantile sketch.
HLL_SIZE, KLL_SIZE = 12, 400
#: Relative standard error of an estimated distinct count, and error of a quantile's rank, with these sizes.
HLL_ERROR, KLL_ERROR = 1.04 / 2 ** (HLL_SIZE / 2), 0.01


def sketches(df: DataFrame, keys: Sequence[str], distinct: str, value: str) -> DataFrame:
    """``keys, n, ids, spread``: rows, a sketch of the ids and one of the values (null values do not count)."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(distinct, HLL_SIZE).alias("ids"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("spread"),
    )


def merge_sketches(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored sketches of finer keys, merged."""
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("spread").alias("spread")
    )


def read_sketches(merged: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """Estimates in place of the sketches: ``distinct`` and ``quantiles``."""
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("spread", F.lit(float(f))) for f in fractions])
    return merged.withColumns({"distinct": F.hll_sketch_estimate("ids"), "quantiles": quantiles}).drop("ids", "spread")


def bitmaps(df: DataFrame, keys: Sequence[str], ids: str) -> DataFrame:
    """``keys, n, bucket, bits``: one bitmap per 32,768 neighbouring ids, so a key with many ids is many rows."""
    bucket = F.bitmap_bucket_number(F.col(ids)).alias("bucket")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(ids)))
    return df.groupBy(*keys, bucket).agg(F.count("*").alias("n"), bits.alias("bits"))


def distinct_rollup(parts: DataFrame, keys: Sequence[str], ids: str = "distinct") -> DataFrame:
    """Exact distinct ids and rows for ``keys``, for every leading part of them, and for all rows.

    Bitmaps of a bucket are joined by OR; buckets hold different ids, so their counts add up.
    """
    merged = parts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.bitmap_or_agg("bits").alias("bits"))
    sets = [keys[:i] for i in range(len(keys), -1, -1)]
    levels = merged.groupingSets([[*map(F.col, s), F.col("bucket")] for s in sets], *keys, "bucket").agg(
        F.sum("n").alias("n"), F.bitmap_or_agg("bits").alias("bits"), F.grouping_id().alias("level")
    )
    counted: Column = F.sum(F.bitmap_count("bits"))
    return levels.groupBy(*keys, "level").agg(F.sum("n").alias("n"), counted.alias(ids)).drop("level")
