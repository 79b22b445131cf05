"""User code the Spark way: vectorised scalar functions, two-phase aggregates, table functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.LongType())
def digit_sum(values: pa.Array) -> pa.Array:
    """Sum of the decimal digits of whole numbers, a column of them at a time; null for null."""
    known = values.fill_null(0).to_numpy(zero_copy_only=False)
    # the smallest long has no positive form that fits, so digits are taken from unsigned numbers
    left = np.where(known < 0, 0 - known.view(np.uint64), known.view(np.uint64))
    total = np.zeros(len(left), np.int64)
    while left.any():
        total += (left % np.uint64(10)).astype(np.int64)
        left //= np.uint64(10)
    return pa.array(total, mask=values.is_null().to_numpy(zero_copy_only=False))


def geometric_mean(df: DataFrame, key: str, value: str, name: str = "geo_mean") -> DataFrame:
    """Geometric mean per key as a two-phase user aggregate.

    The Python phase reduces each Arrow batch to one partial row per key; partials are merged by built-in
    sums. No task ever holds a whole group, unlike a grouped-aggregate function. A null key is a key; null values
    do not count, and a key with no others has a null mean.
    """

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            logs = pd.DataFrame({"key": batch[key], "log_sum": np.log(batch[value]), "n": batch[value].notna().astype("int64")})
            yield logs.groupby("key", as_index=False, dropna=False).sum()

    kind = df.schema[key].dataType.simpleString()
    merged = df.select(key, value).mapInPandas(partials, f"key {kind}, log_sum double, n bigint").groupBy("key")
    mean: Column = F.exp(F.try_divide(F.sum("log_sum"), F.sum("n")))
    return merged.agg(mean.alias(name)).withColumnRenamed("key", key)


@F.arrow_udtf(returnType="role string, ngram string")
class Ngrams:
    """Word n-grams of a table's ``text``, with its ``role``, one row each; a null text has none.

    Takes the table batch by batch: a vectorised table function cannot stand in a lateral join.
    """

    def eval(self, rows: pa.RecordBatch, size: pa.Array) -> Iterator[pa.Table]:
        n = size[0].as_py()
        roles, grams = [], []
        words = pc.split_pattern(rows.column("text"), " ").to_pylist()
        for role, found in zip(rows.column("role").to_pylist(), words, strict=True):
            new = [" ".join(found[i : i + n]) for i in range(len(found or ()) - n + 1)]
            roles += [role] * len(new)
            grams += new
        yield pa.table({"role": pa.array(roles, pa.string()), "ngram": pa.array(grams, pa.string())})
