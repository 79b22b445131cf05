"""Latest row per key: upsert, log compaction, retention, and the view without deleted rows.

``row_number() = 1`` is planned with a partial group limit before the shuffle, so every map task sends at
most one row per key. A key that holds a third of all rows costs no more shuffle than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_COMPACTION_LAG = timedelta(days=7)


def _descending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in order]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest ``order`` per key. List enough order columns to rule out ties."""
    newest_first = Window.partitionBy(*keys).orderBy(*_descending(order))
    return df.withColumn("_rank", F.row_number().over(newest_first)).filter("_rank = 1").drop("_rank")


def identity(ids: Sequence[str], partition_by: str | None, scope: str) -> list[str]:
    """Columns that identify a stored row.

    With ``scope='partition'`` a row is replaced only inside its partition, so a key whose partition value
    moves is kept once per partition; with ``scope='global'`` the key is unique in the table.
    """
    if not ids:
        raise ValueError("an upsert needs id columns")
    if scope not in ("partition", "global"):
        raise ValueError(f"unknown scope: {scope}")
    scoped = scope == "partition" and partition_by is not None and partition_by not in ids
    return [*ids, partition_by] if scoped else list(ids)


def resolve_ids(table: str, per_table: dict[str, Sequence[str]], default: Sequence[str]) -> list[str]:
    """Id columns of a table: its own setting, else the default ones."""
    ids = per_table.get(table) or default
    if not ids:
        raise ValueError(f"no id columns for {table}")
    return list(ids)


def _same_key(left: str, right: str, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def upsert(
    current: DataFrame,
    batch: DataFrame,
    ids: Sequence[str],
    order: Sequence[str],
    partition_by: str | None = None,
    scope: str = "global",
) -> DataFrame:
    """Merge a batch into a table by id columns; the row with the higher ``order`` wins, whichever came first.

    Of equal ones the batch wins. One shuffle of table and batch together. Use :func:`upsert_small` when the batch is a sliver of the table.
    """
    keys = identity(ids, partition_by, scope)
    arrived = current.withColumn("_arrival", F.lit(0)).unionByName(
        batch.withColumn("_arrival", F.lit(1)), allowMissingColumns=True
    )
    return latest_per_key(arrived, keys, [*order, "_arrival"]).drop("_arrival")


def upsert_small(
    current: DataFrame,
    batch: DataFrame,
    ids: Sequence[str],
    order: Sequence[str],
    partition_by: str | None = None,
    scope: str = "global",
) -> DataFrame:
    """Same result as :func:`upsert` for a table that is already unique by key, without moving the table.

    Both joins have the batch on the build side, so the optimizer broadcasts it while its measured size
    allows that and falls back to a shuffled join beyond; the table is scanned twice, once for keys only.
    """
    keys = identity(ids, partition_by, scope)
    incoming = latest_per_key(batch, keys, order)
    newer = F.struct(*[F.col(f"t.{c}") for c in order]) > F.struct(*[F.col(f"b.{c}") for c in order])
    outdated = (
        current.select(*{*keys, *order})
        .alias("t")
        .join(incoming.select(*{*keys, *order}).alias("b"), _same_key("t", "b", keys) & newer)
        .select("b.*")
        .select(*keys)
    )
    fresh = incoming.alias("i").join(outdated.alias("o"), _same_key("i", "o", keys), "left_anti")
    kept = current.alias("t").join(fresh.select(*keys).alias("f"), _same_key("t", "f", keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def current_rows(df: DataFrame) -> DataFrame:
    """Deletes are stored as rows with ``__deleted = 'true'``; readers see the others."""
    return df.filter(F.coalesce(F.col("__deleted"), F.lit("false")) != "true")


def compact(
    log: DataFrame, key: Sequence[str], offset: str, ts: str, now: Column, lag: timedelta = DEFAULT_COMPACTION_LAG
) -> DataFrame:
    """Keep every record younger than ``lag`` and, of the older ones, the latest per key.

    Records inside the lag never enter the shuffle. A record without a time has no age and stays.
    """
    old = F.coalesce(F.col(ts) < now - F.lit(lag), F.lit(False))
    return log.filter(~old).unionByName(latest_per_key(log.filter(old), key, [offset]))


def retain(log: DataFrame, ts: str, now: Column, retention: timedelta) -> DataFrame:
    """Drop records past the retention age; one without a time has none and stays."""
    return log.filter(F.col(ts).isNull() | (F.col(ts) >= now - F.lit(retention)))


def clean(
    log: DataFrame,
    policy: str,
    key: Sequence[str],
    offset: str,
    ts: str,
    now: Column,
    retention: timedelta,
    lag: timedelta = DEFAULT_COMPACTION_LAG,
) -> DataFrame:
    """Apply a topic's cleanup policy: ``delete``, ``compact`` or both."""
    policies = {p.strip() for p in policy.split(",")}
    if not policies or policies - {"compact", "delete"}:
        raise ValueError(f"unknown cleanup policy: {policy}")
    if "delete" in policies:
        log = retain(log, ts, now, retention)
    return compact(log, key, offset, ts, now, lag) if "compact" in policies else log
