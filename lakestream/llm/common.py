"""What the operators share: the word pattern, null-safe keys, tables in the shared folder, prefix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakestream.session import work_dir

#: A word is a run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns cannot clash with any of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(filled(text), F.lit(WORD)).cast("long")


def one_spaced(text: Column) -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(filled(text), SPACE, " ")


def key_of(*columns: Column) -> Column:
    """Columns as one join key in which null equals null."""
    return F.struct(*columns)


def slices(lengths: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``limit`` characters, at least one row each."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def prefix_sums(
    rows: DataFrame, group: str, digest: str, order: Sequence[str], value: str, before: str, total: str
) -> DataFrame:
    """Add to each row of ``group`` the sum of ``value`` over the rows before it, and the whole group's sum.

    Rows follow the hex string ``digest`` (hash values, so evenly spread), then ``order``. No window holds a
    whole group: the first three hex digits name a shelf, the next three a slot of it. Sums go from rows to
    slots, from slots to shelves, and back down, so a window holds 4,096 shelves, 4,096 slots, or the few rows
    of a slot. ``digest`` must not be null; a null group is a group.
    """
    shelf, slot = F.substring(digest, 1, 3), F.substring(digest, 1, 6)
    placed = rows.withColumns({"_shelf": shelf, "_slot": slot})
    slots = placed.groupBy(group, "_shelf", "_slot").agg(F.sum(value).alias("_sum"))
    shelves = slots.groupBy(group, "_shelf").agg(F.sum("_sum").alias("_shelf_sum"))
    earlier = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    by_shelf = Window.partitionBy(group)
    shelves = shelves.select(
        F.col(group).alias("_g"),
        F.col("_shelf").alias("_s"),
        F.coalesce(F.sum("_shelf_sum").over(by_shelf.orderBy("_shelf").rowsBetween(*earlier)), zero).alias("_base"),
        F.sum("_shelf_sum").over(by_shelf).alias(total),
    )
    by_slot = Window.partitionBy(group, "_shelf").orderBy("_slot").rowsBetween(*earlier)
    slots = slots.withColumn("_in_shelf", F.coalesce(F.sum("_sum").over(by_slot), zero))
    slots = slots.join(shelves, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_shelf") == F.col("_s"))).select(
        F.col(group).alias("_g"),
        F.col("_slot").alias("_s"),
        (F.col("_base") + F.col("_in_shelf")).alias("_base"),
        total,
    )
    inside = Window.partitionBy(group, "_slot").orderBy(digest, *order).rowsBetween(*earlier)
    placed = placed.withColumn("_in_slot", F.coalesce(F.sum(value).over(inside), zero))
    joined = placed.join(slots, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slot") == F.col("_s")))
    return joined.select(*rows.columns, (F.col("_base") + F.col("_in_slot")).alias(before), total)
