"""Tables clustered on several columns at once, so that Parquet statistics skip rows on each of them.

A sort by one column leaves the others spread over all files. Here rows are sorted by the interleaved bits of the
columns' ranks (a Z-order): a file covers a narrow range of every one of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a rank: 255 bounds per column.
RANK_BITS = 8


def rank_bounds(df: DataFrame, columns: Sequence[str], bits: int = RANK_BITS) -> dict[str, list]:
    """Bounds that cut each column into ``2 ** bits`` parts of about equal rows: one aggregate over the table."""
    fractions = [i / 2**bits for i in range(1, 2**bits)]
    found = df.agg(*[F.percentile_approx(c, fractions, 100 * 2**bits).alias(c) for c in columns]).first()
    return {c: list(found[c] or []) for c in columns}


def rank(column: str, bounds: Sequence, kind, bits: int = RANK_BITS) -> Column:
    """How many bounds a value reaches, by binary search; null is rank 0."""
    if not bounds:
        return F.lit(0)
    limits = F.array(*[F.lit(b).cast(kind) for b in bounds])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    reach = lambda at, step: F.when(F.col(column) >= F.element_at(limits, at + step), step).otherwise(0)
    return F.aggregate(steps, F.lit(0), lambda at, step: at + reach(at, step))


def interleaved(ranks: Sequence[Column], bits: int = RANK_BITS) -> Column:
    """Bits of the ranks in turn, highest first, as one number."""
    out = F.lit(0).cast("long")
    for bit in range(bits):
        for i, r in enumerate(ranks):
            place = bit * len(ranks) + i
            out = out.bitwiseOR(F.shiftleft(F.shiftright(r, bit).bitwiseAND(1).cast("long"), place))
    return out


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int | None = None, bits: int = RANK_BITS) -> None:
    """Write rows in the order of the interleaved ranks of two or three ``columns``, ranged over ``files``.

    Without ``files`` the session's shuffle settings decide. Rows of one place are spread by a hash of the row, so one
    frequent combination of values may be many files.
    """
    if not 1 < len(columns) <= 63 // bits:
        raise ValueError(f"cluster by 2 to {63 // bits} columns")
    bounds = rank_bounds(df, columns, bits)
    ranks = {f"_rank{i}": rank(c, bounds[c], df.schema[c].dataType, bits) for i, c in enumerate(columns)}
    placed = df.withColumns(ranks).withColumn("_place", interleaved([F.col(r) for r in ranks], bits)).drop(*ranks)
    order = ["_place", "_spread"]
    placed = placed.withColumn("_spread", F.xxhash64(*df.columns))
    ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).drop(*order).write.mode("overwrite").parquet(path)
