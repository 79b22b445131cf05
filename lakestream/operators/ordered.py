"""Windows over long ordered groups, split so that no group is sorted in one task.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here a key's rows are first cut into
chunks that follow the order: a band of values, a run of positions, or slices of time packed by their measured
row counts. Work inside a chunk is a window over ``(key, chunk)``; what crosses chunks is either a per-chunk summary
(totals, last value), small enough for a window over the key, or a few neighbouring rows copied into the next chunk (a
halo). A null key is a key, and a null time stands last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000
#: Rows a packed chunk aims at.
CHUNK_ROWS = 65_536
#: Keys longer than a chunk that are gathered and broadcast.
FEW_KEYS = 10_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (session zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the columns of ``on`` are the left ones."""
    others = [c for c in right.columns if c not in on]
    named = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *others)
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    joined = left.join(named, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_on_{c}" for c in on])


def long_keys(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame | None:
    """Keys with more than ``rows`` rows, or None: there are at most as many as the table has times ``rows`` rows.

    A few are gathered and known by size, so that the rows are joined to them where they are; if there are very many, both sides
    are shuffled.
    """
    heavy = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).select(*keys)
    some = heavy.limit(FEW_KEYS + 1).collect()
    if not some:
        return None
    return heavy if len(some) > FEW_KEYS else F.broadcast(df.sparkSession.createDataFrame(some, heavy.schema))


def packed(
    df: DataFrame, keys: Sequence[str], at: Column, tie: str | None = None, width: int = MICROS, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``_chunk``, a number that follows ``at`` within the key, such that a chunk holds about ``rows`` rows.

    A key with no more rows is one chunk, which takes no shuffle to know. Rows of longer keys are counted per slice of
    ``width``; whole slices go into a chunk until it is full, so it never holds more than ``rows`` plus one slice,
    however the rows lie in time. Rows with a null ``at`` come last, sliced by ``tie``.
    """
    heavy = long_keys(df, keys, rows)
    whole = F.lit(0).cast("long").alias("_chunk")
    if heavy is None:
        return df.select("*", whole)
    none = F.lit(None).cast("long")
    cut = null_safe_join(df, heavy, keys, "left_semi").withColumns(
        {
            "_slice": F.floor(at / F.lit(width)).cast("long"),
            "_rest": none if tie is None else F.when(at.isNull(), F.floor(F.col(tie) / 4096)).cast("long"),
        }
    )
    dealt = cut.withColumn("_place", F.struct(*keys, "_slice", "_rest"))
    counts = dealt.groupBy("_place").agg(F.count("*").alias("_n"))
    order = [F.col(f"_place.{c}").asc_nulls_last() for c in ("_slice", "_rest")]
    before = Window.partitionBy(*[F.col(f"_place.{k}") for k in keys]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows).cast("long")
    long = dealt.join(counts.select("_place", chunk.alias("_chunk")), "_place").select(*df.columns, "_chunk")
    return null_safe_join(df, heavy, keys, "left_anti").select("*", whole).unionByName(long)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[Column],
    sums: dict[str, Column],
    descending_chunks: bool = False,
) -> DataFrame:
    """Add inclusive running sums per key. ``chunk`` must follow ``order``; rows of a tie are added one by one.

    The rows are shuffled once by ``(key, chunk)``; the totals of earlier chunks come from a pre-aggregated
    side with one row per key and chunk.
    """
    inputs = df.withColumns({f"_in_{name}": value for name, value in sums.items()} | {"_part": F.struct(*keys, chunk)})
    totals = inputs.groupBy("_part").agg(*[F.sum(f"_in_{n}").alias(f"_total_{n}") for n in sums])
    at = F.col(f"_part.{chunk}")
    earlier = Window.partitionBy(*[F.col(f"_part.{k}") for k in keys]).orderBy(at.desc() if descending_chunks else at.asc())
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "_part", *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )
    # join and window go by one column, so the rows move once
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = inputs.join(before, "_part")
    return joined.select(
        *df.columns, *[(F.sum(f"_in_{n}").over(inside) + F.col(f"_before_{n}")).alias(n) for n in sums]
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[Column],
    name: str = "rn",
    descending_chunks: bool = False,
) -> DataFrame:
    """``row_number`` over the whole key; ``order`` must leave no ties."""
    return running_sums(df, keys, chunk, order, {name: F.lit(1)}, descending_chunks)


def halo(df: DataFrame, position: str, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cut rows into ``_chunk``s of ``width`` positions and copy edge rows into the neighbouring chunks.

    Each row of a chunk then finds the rows up to ``before`` positions behind and ``after`` ahead in its own
    chunk. Keep ``_own`` rows after the window; the others are copies.
    """
    if before > width or after > width:
        raise ValueError("a halo cannot be wider than its chunk")
    at = F.floor(F.col(position) / F.lit(width)).cast("long")
    first = F.floor((F.col(position) - F.lit(after)) / F.lit(width)).cast("long")
    last = F.floor((F.col(position) + F.lit(before)) / F.lit(width)).cast("long")
    return (
        df.withColumn("_home", at)
        .withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def over_positions(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    columns: dict[str, tuple[Column, int, int]],
    width: int = 4096,
) -> DataFrame:
    """Add ``{name: (aggregate, first, last)}`` over positions ``[p + first, p + last]`` of the key.

    Positions are dense row numbers, so this is a ROWS frame, and ``(min(x), -1, -1)`` is ``lag(x)``. A frame is
    computed anew for each row: for wide frames take :func:`sums_between`.
    """
    before = max(0, *(-lo for _, lo, _ in columns.values()))
    after = max(0, *(hi for _, _, hi in columns.values()))
    window = Window.partitionBy(*keys, "_chunk").orderBy(position)
    framed = {name: agg.over(window.rangeBetween(lo, hi)) for name, (agg, lo, hi) in columns.items()}
    haloed = halo(df, position, max(width, before, after), before, after)
    return haloed.withColumns(framed).filter("_own").drop("_own", "_chunk")


def sums_between(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    first: int,
    last: int,
    sums: dict[str, Column],
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add to each left row the ``sums`` over the key's right rows with ``at`` in ``[p + first, p + last]``.

    A sum over a frame is the difference of two running sums, one read at each of its ends. Right rows and both
    ends of every left row stand in one order, so the work grows with the rows, not with the frame. Equal left rows
    stay apart; ``at`` is a whole number, not null.
    """
    ends = F.explode(
        F.array(
            F.struct((F.col(at) + last).alias("_at"), F.lit(1).alias("_sign")),
            F.struct((F.col(at) + first - 1).alias("_at"), F.lit(-1).alias("_sign")),
        )
    )
    weights = {f"_w_{n}": c for n, c in sums.items()}
    numbered = left.withColumn("_row", F.monotonically_increasing_id())
    probes = numbered.withColumn("_end", ends).select(*numbered.columns, "_end.*")
    # a right row at an end's position counts, so it stands before the end
    points = right.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_sign"), *[c.alias(n) for n, c in weights.items()])
    both = packed(points.unionByName(probes, allowMissingColumns=True), keys, F.col("_at"), rows=rows)
    values = {f"_run_{n}": F.coalesce(F.col(f"_w_{n}"), F.lit(0)) for n in sums}
    run = running_sums(both, keys, "_chunk", [F.col("_at"), F.abs("_sign")], values)
    totals = [F.sum(F.col("_sign") * F.col(f"_run_{n}")).alias(n) for n in sums]
    return run.filter("_sign != 0").groupBy(*left.columns, "_row").agg(*totals).drop("_row")


def last_known(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add the last non-null ``value`` of the key up to and including each row.

    The value a chunk ends with is read off its last row, so it needs no shuffle beyond the one of the rows.
    """
    inside = Window.partitionBy("_part").orderBy(*order)
    seen = df.withColumn("_part", F.struct(*keys, chunk)).withColumns(
        {
            "_seen": F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "_is_last": F.lead(F.lit(True)).over(inside).isNull(),
        }
    )
    of_key = Window.partitionBy(*[F.col(f"_part.{k}") for k in keys]).orderBy(F.col(f"_part.{chunk}"))
    carried = seen.filter("_is_last").select(
        "_part", F.last("_seen", ignorenulls=True).over(of_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried")
    )
    return seen.join(carried, "_part").select(*df.columns, F.coalesce("_seen", "_carried").alias(name))


def quantile_positions(
    df: DataFrame, keys: Sequence[str], value: str, band: Column, fractions: Sequence[float]
) -> DataFrame:
    """Exact interpolated percentiles per key, named ``p<percent>``; null values do not count.

    Works on counts per distinct value, cut into bands of values, so neither a key with many rows nor one
    with many values is held in one task. A key with null values only has null percentiles.
    """
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    cumulative = running_sums(
        counts.withColumn("_band", band), keys, "_band", [F.col(value)], {"_upto": F.col("_n")}
    )
    totals = counts.groupBy(*keys).agg((F.sum("_n") - 1).alias("_span"))
    placed = null_safe_join(cumulative, totals, keys)
    out = []
    for f in fractions:
        at = F.col("_span") * F.lit(f)
        # value at 0-based index i is the smallest one whose cumulative count exceeds i
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value)))
        share = F.max(at - F.floor(at))
        out.append((low + (high - low) * share).alias(f"p{round(f * 100)}"))
    return placed.groupBy(*keys).agg(*out)


def _ranked_in_bands(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Places from windows over bands of values, and the rows and distinct values of higher bands."""
    bands = rows.groupBy(*keys, "_band").agg(
        F.count("*").alias("_n"), (F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("_values")
    )
    higher = Window.partitionBy(*keys).orderBy(F.col("_band").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(
        F.struct(*keys, "_band").alias("_part"),
        F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_rows_above"),
        F.coalesce(F.sum("_values").over(higher), F.lit(0)).alias("_values_above"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    inside = Window.partitionBy("_part")
    by_value, by_row = inside.orderBy(F.col(value).desc_nulls_last()), inside.orderBy(F.col(value).desc_nulls_last(), tie)
    placed = rows.withColumn("_part", F.struct(*keys, "_band")).withColumns(
        {
            "_rank": F.rank().over(by_value),
            "_dense": F.dense_rank().over(by_value),
            "_upto": F.count("*").over(by_value),
            "_number": F.row_number().over(by_row),
        }
    )
    above = F.col("_rows_above")
    return placed.join(bands, "_part").withColumns(
        {
            "_rank": F.col("_rank") + above,
            "_dense": F.col("_dense") + F.col("_values_above"),
            "_upto": F.col("_upto") + above,
            "_number": F.col("_number") + above,
        }
    )


def _ranked_by_counts(rows: DataFrame, keys: list[str], value: str, tie: str, size: int) -> DataFrame:
    """Places from counts per distinct value, and of a row among those of its value, numbered in chunks by ``tie``."""
    counts = rows.groupBy(*keys, value, "_band").agg(F.count("*").alias("_n"))
    sums = {"_upto": F.col("_n"), "_dense": F.lit(1)}
    counts = running_sums(counts, keys, "_band", [F.col(value).desc_nulls_last()], sums, descending_chunks=True)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    counts = null_safe_join(counts, totals, keys).select(F.struct(*keys, value).alias("_value"), "_n", "_upto", "_dense", "_total")
    placed = rows.withColumn("_value", F.struct(*keys, value)).join(counts, "_value")
    cut = packed(placed, ["_value"], F.col(tie), width=4096, rows=size)
    placed = number_rows(cut, ["_value"], "_chunk", [F.col(tie)], "_place")
    above = F.col("_upto") - F.col("_n")
    return placed.withColumns({"_rank": above + 1, "_number": above + F.col("_place")})


def ranked(
    df: DataFrame, keys: Sequence[str], value: str, band: Column, tie: str, tiles: int, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add every ranking of ``value`` descending within the key, null last; ``tie``, a unique whole number, orders equal values.

    No window holds more than about ``rows`` rows: rows are ranked inside their band of values while every band is
    short, else by counts per value, so that a frequent value is numbered in chunks.
    """
    keys = list(keys)
    banded = df.withColumn("_band", band)
    if long_keys(banded, [*keys, "_band"], rows) is None:
        placed = _ranked_in_bands(banded, keys, value, tie)
    else:
        placed = _ranked_by_counts(banded, keys, value, tie, rows)
    number, total = F.col("_number"), F.col("_total")
    share = F.when(total > 1, (F.col("_rank") - 1) / (total - 1)).otherwise(0.0)
    base, extra = F.floor(total / tiles), total % tiles
    # the first ``extra`` tiles hold one row more
    wide = extra * (base + 1)
    tile = F.when(number <= wide, F.floor((number - 1) / (base + 1)) + 1).otherwise(
        extra + F.floor((number - 1 - wide) / base) + 1
    )
    return placed.select(
        *df.columns,
        F.col("_rank").cast("long").alias("rank"),
        F.col("_dense").cast("long").alias("dense_rank"),
        (F.col("_upto") / total).alias("cume_dist"),
        number.cast("long").alias("row_number"),
        share.alias("percent_rank"),
        tile.cast("int").alias("ntile"),
    )
