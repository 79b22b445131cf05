"""Time-based joins and sessions over keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakestream.operators.ordered import CHUNK_ROWS, MICROS, last_known, micros, packed


def can_match(keys: Sequence[str], ts: str) -> Column:
    """A join on keys and time finds nothing for a row in which one of them is null."""
    known = F.col(ts).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    values: Sequence[str],
    forward: bool = False,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """For each left row the latest right row of the key at or before it; ``values`` are null without one.

    ``forward`` takes the earliest right row after it instead. Left and right share ``keys``, ``ts`` and the unique
    column ``tie`` that orders rows of the same instant. A left row with a null key or time stays, unmatched.
    """
    match = F.struct(*[F.col(v) for v in values])
    others = [c for c in left.columns if c not in (*keys, ts, tie)]
    known = can_match(keys, ts)
    at = micros(F.col(ts)) * (-1 if forward else 1)
    lookup = right.filter(known).select(*keys, ts, tie, match.alias("_match"))
    side = left.filter(known).select(*keys, ts, tie, F.struct(*[F.col(c) for c in others]).alias("_row"))
    both = side.unionByName(lookup, allowMissingColumns=True).withColumns(
        {
            "_at": at,
            # a right row of the same instant is already known backwards, and not yet forwards
            "_side": F.when(F.col("_match").isNull() == F.lit(forward), 0).otherwise(1),
        }
    )
    both = packed(both, keys, F.col("_at"), rows=rows)
    found = last_known(both, keys, "_chunk", ["_at", "_side", tie], "_match", "_known").filter("_match IS NULL")
    matched = found.select(
        *keys, ts, tie, *[F.col(f"_row.{c}").alias(c) for c in others], *[F.col(f"_known.{v}").alias(v) for v in values]
    )
    return matched.unionByName(left.filter(~known), allowMissingColumns=True)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    seconds: int,
    count: str,
    first: str,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per left row, how many right rows of its key lie in ``(ts, ts + seconds]`` and the first one's microseconds.

    Pairs are never built. Right rows and both ends of every left row stand in one order, cut into chunks: the count
    is the difference of the running counts at the two ends, and the first row the next one after the start. Equal left
    rows stay apart. A left row with a null key or time stays, with a count of 0.
    """
    known, width = can_match(keys, ts), seconds * MICROS
    none = F.lit(None).cast("long")
    placed = left.withColumns({"_from": micros(F.col(ts)), "_row": F.monotonically_increasing_id()})
    ends = F.array(*[F.struct((F.col("_from") + d).alias("_at"), F.lit(s).alias("_sign")) for d, s in ((0, -1), (width, 1))])
    probes = placed.filter(known).select(*placed.columns, F.inline(ends), none.alias("_point"))
    points = right.filter(known).select(*keys, micros(F.col(ts)).alias("_at"), F.lit(0).alias("_sign"))
    points = points.withColumn("_point", F.col("_at"))
    both = packed(points.unionByName(probes, allowMissingColumns=True), keys, F.col("_at"), rows=rows)
    # join and windows go by one column, so the rows move once
    both = both.withColumn("_part", F.struct(*keys, "_chunk"))
    chunks = both.groupBy("_part").agg(F.count("_point").alias("_n"), F.min("_point").alias("_first"))
    before, inside = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    of_key, of_chunk = Window.partitionBy(*[F.col(f"_part.{k}") for k in keys]), Window.partitionBy("_part")
    number = F.col("_part._chunk")
    chunks = chunks.select(
        "_part",
        F.coalesce(F.sum("_n").over(of_key.orderBy(number).rowsBetween(*before)), F.lit(0)).alias("_before"),
        F.min("_first").over(of_key.orderBy(number.desc()).rowsBetween(*before)).alias("_after"),
    )
    # a right row at an end's instant is counted there, and is not after it
    upwards = of_chunk.orderBy("_at", F.col("_point").isNull()).rowsBetween(*inside)
    downwards = of_chunk.orderBy(F.desc("_at"), F.col("_point").isNotNull()).rowsBetween(*inside)
    run = both.withColumns({"_run": F.count("_point").over(upwards), "_next": F.min("_point").over(downwards)})
    run = run.filter("_sign != 0").join(chunks, "_part")
    following = F.max(F.when(F.col("_sign") < 0, F.coalesce("_next", "_after")))
    found = run.groupBy(*placed.columns).agg(
        F.sum(F.col("_sign") * (F.col("_run") + F.col("_before"))).alias(count), following.alias("_next")
    )
    near = F.when(F.col("_next") <= F.col("_from") + width, F.col("_next"))
    unknown = placed.filter(~known).select("*", F.lit(0).cast("long").alias(count), none.alias("_next"))
    return found.unionByName(unknown).withColumn(first, near).drop("_next", "_from", "_row")


def range_join(
    points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``points`` with the ranges ``[low, high)`` that hold them.

    A range lies in cells of its own size: the smallest power of two times ``width`` it fits into, of which it
    touches two at most, so a wide range is no more rows than a narrow one. The join is an equi-join on size and
    cell; a point looks into one cell of each size there is, and a cell with very many points is split at run time
    as any skewed join key. A range or point with a null bound, value or key matches nothing.
    """
    span = F.greatest((F.col(high) - F.col(low)) / F.lit(width), F.lit(1.0))
    sized = ranges.filter(F.col(high) > F.col(low)).withColumn("_size", F.ceil(F.log2(span)).cast("int"))
    cell = lambda value: F.floor(value / (F.lit(width) * F.pow(F.lit(2.0), F.col("_size")))).cast("long")
    cut = sized.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col(low)), cell(F.col(high))))))
    # exponents of doubles: about two thousand different ones at the very most
    sizes = sorted(row["_size"] for row in sized.select("_size").distinct().collect() if row["_size"] is not None)
    each = F.explode(F.array(*[F.lit(size) for size in sizes]).cast("array<int>"))
    placed = points.withColumn("_size", each).withColumn("_cell", cell(F.col(point)))
    inside = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    return placed.join(cut, ["_size", "_cell", *keys]).filter(inside).drop("_size", "_cell")


def sessionize(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    gap_seconds: int,
    sums: dict[str, Column],
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Sessions per key: a new one starts when the gap to the previous row reaches ``gap_seconds``.

    Output: keys, ``session_start``, ``session_end`` (last row plus gap) and the ``sums``. Sessions are built
    inside chunks of rows; only the first and last of each chunk can continue across its border, and only
    those are looked at per key. A row without a time is a session of its own, without start and end.
    """
    gap = gap_seconds * MICROS
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_at", tie)
    inputs = df.withColumns({"_at": micros(F.col(ts))} | {f"_in_{n}": c for n, c in sums.items()})
    timed = packed(inputs.filter("_at IS NOT NULL"), keys, F.col("_at"), rows=rows)
    starts = F.col("_at") - F.lag("_at").over(inside) >= gap
    counted = timed.withColumn("_new", F.when(starts, 1).otherwise(0)).withColumn(
        "_sid", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    parts = counted.groupBy(*keys, "_chunk", "_sid").agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), *[F.sum(f"_in_{n}").alias(n) for n in sums]
    )
    in_chunk = Window.partitionBy(*keys, "_chunk")
    parts = parts.withColumn("_edge", (F.col("_sid") == 0) | (F.col("_sid") == F.max("_sid").over(in_chunk)))

    per_key = Window.partitionBy(*keys).orderBy("_first", "_chunk", "_sid")
    apart = F.col("_first") - F.lag("_last").over(per_key) >= gap
    edges = (
        parts.filter("_edge")
        .withColumn("_new", F.when(apart, 1).otherwise(0))
        .withColumn("_run", F.sum("_new").over(per_key.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), *[F.sum(n).alias(n) for n in sums])
        .drop("_run")
    )
    untimed = inputs.filter("_at IS NULL").select(
        *keys, F.col("_at").alias("_first"), F.col("_at").alias("_last"), *[F.col(f"_in_{n}").alias(n) for n in sums]
    )
    whole = parts.filter(~F.col("_edge")).select(*edges.columns).unionByName(edges).unionByName(untimed)
    return whole.select(
        *keys,
        F.timestamp_micros("_first").cast("timestamp_ntz").alias("session_start"),
        F.timestamp_micros(F.col("_last") + gap).cast("timestamp_ntz").alias("session_end"),
        *sums,
    )
