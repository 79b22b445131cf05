"""Row fingerprints and table drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(cols: Sequence[Column]) -> Column:
    """Text form of a row: values joined by a unit separator, null as a record separator.

    Cast floating-point columns to a decimal first: their text differs between engines.
    """
    return F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in cols])


def fingerprint(cols: Sequence[Column]) -> Column:
    """First 16 lower-case hex digits of the SHA-256 of a row."""
    return F.substring(F.sha2(canonical(cols), 256), 1, 16)


def changed_rows(old: DataFrame, new: DataFrame, key: Sequence[str], cols: Sequence[Column]) -> DataFrame:
    """Keys of both versions with ``change`` = added, removed, changed or same.

    Only key and fingerprint are shuffled, whatever the width of the table.
    """
    left = old.select(*key, fingerprint(cols).alias("old_print"))
    right = new.select(*key, fingerprint(cols).alias("new_print"))
    change = (
        F.when(F.col("old_print").isNull(), "added")
        .when(F.col("new_print").isNull(), "removed")
        .when(F.col("old_print") != F.col("new_print"), "changed")
        .otherwise("same")
    )
    return left.join(right, list(key), "full").withColumn("change", change)
