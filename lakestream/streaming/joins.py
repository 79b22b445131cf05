"""Silver tables kept up to date by streams: per-customer summaries and the join of two changing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestream.operators.latest import current_rows, latest_per_key
from lakestream.operators.ordered import null_safe_join
from lakestream.sources.lake import append, fold_when, read_table_log, read_upserted


def merge_aggregate(
    delta: DataFrame, path: str, commit: int, keys: Sequence[str], merges: dict[str, Column]
) -> None:
    """Add a batch of partial aggregates to a stored aggregate table.

    ``merges`` folds stored and new rows of a key, e.g. ``{"n": F.sum("n")}``. Only commits before this one
    are read, and only the keys of the batch, so replaying the batch changes nothing.
    """
    spark = delta.sparkSession
    rows = delta
    if read_table_log(spark, path).schema is not None:
        stored = read_upserted(spark, path, keys, [], upto=commit - 1, only=delta)
        rows = stored.select(*delta.columns).unionByName(delta)
    append(rows.groupBy(*keys).agg(*[col.alias(name) for name, col in merges.items()]), path, commit)


def maintain_join(
    left: DataFrame,
    right: DataFrame,
    left_path: str,
    right_path: str,
    out_path: str,
    commit: int,
    on: Sequence[str],
    order: Sequence[str],
    how: str = "inner",
) -> None:
    """Apply one batch of changes of either side to both inputs and to the joined table.

    Inputs and result are upsert tables keyed by ``on``; a side of the batch may be empty. The result equals the
    batch join of the latest rows after every commit, whatever the order of arrival.
    """
    for side, path in ((left, left_path), (right, right_path)):
        append(latest_per_key(side, on, order), path, commit)
    refresh_join(left.select(*on).unionByName(right.select(*on)), left_path, right_path, out_path, commit, on, order, how)


def refresh_join(
    touched: DataFrame,
    left_path: str,
    right_path: str,
    out_path: str,
    commit: int,
    on: Sequence[str],
    order: Sequence[str],
    how: str = "inner",
) -> None:
    """Join the touched keys again from the current inputs; a key without a joined row is written as deleted."""
    spark, keys = touched.sparkSession, list(on)
    touched = touched.distinct()

    def current(path: str) -> DataFrame:
        rows = read_upserted(spark, path, keys, order, upto=commit, only=touched)
        return (current_rows(rows) if "__deleted" in rows.columns else rows).drop("__deleted", *order)

    joined = current(left_path).join(current(right_path), keys, how).withColumn("__deleted", F.lit("false"))
    gone = null_safe_join(touched, joined.select(*keys), keys, "left_anti").withColumn("__deleted", F.lit("true"))
    append(joined.unionByName(gone, allowMissingColumns=True), out_path, commit)
    for path, order_by in ((left_path, order), (right_path, order), (out_path, [])):
        fold_when(spark, path, keys, order_by)


def keyed_join(stream: DataFrame, keys: Sequence[str], sides: dict[str, Column], both: Sequence[str]) -> DataFrame:
    """A maintained join as one aggregate per key over the union of its topics, for a sink in update mode.

    Rows of all sides come in one stream with null in the columns of the others; ``sides`` are aggregates over
    those, sums for a side that adds up and ``max_by(..., offset)`` for one whose latest row counts. A key is
    emitted whenever a batch changes it, once all of ``both`` are known. State is one row per key, partial aggregates are made
    before the shuffle, and no stored table is read, so a batch costs what it brings. Null keys meet nothing.
    Rows only ever add: where a side can take rows back, use :func:`maintain_join`.
    """
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    joined = stream.filter(known).groupBy(*keys).agg(*[side.alias(name) for name, side in sides.items()])
    for name in both:
        joined = joined.filter(F.col(name).isNotNull())
    return joined


def stream_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    late: str,
    within: str,
    how: str = "inner",
) -> DataFrame:
    """Append-only variant: rows of both streams with equal keys, the right one at most ``within`` after the left.

    With ``how="left"`` a left row without an answer leaves with nulls once the watermarks of both sides are past the
    last moment at which one could come; state is bounded by ``late`` and ``within`` either way.
    """
    a = left.withWatermark(left_ts, late).alias("a")
    b = right.withWatermark(right_ts, late).alias("b")
    near = (F.col(f"b.{right_ts}") >= F.col(f"a.{left_ts}")) & (
        F.col(f"b.{right_ts}") <= F.col(f"a.{left_ts}") + F.expr(f"interval {within}")
    )
    for key in on:
        near = near & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    others = [c for c in right.columns if c not in on]
    return a.join(b, near, how).select("a.*", *[F.col(f"b.{c}") for c in others])
