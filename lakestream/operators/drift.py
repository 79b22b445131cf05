"""Drift between two snapshots by a tree of digests.

A snapshot is stored as keys with their row fingerprints, each in a leaf (a range of keys, or of key hashes), and
with a digest per leaf and per group of 16 below, up to the root. A digest is a row count and two sums by exclusive or,
so it does not depend on the order of rows and digests of children give that of their parent. Two snapshots are
compared from the root down: only children of differing nodes are looked at, and only rows of differing leaves are
joined. Equal snapshots cost one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.functions.hashing import fingerprint
from lakestream.sources.lake import write_partitioned

#: Children of a node, as bits.
FAN_BITS = 4


def hashed_leaf(key: Sequence[str], levels: int) -> Column:
    """Leaf of a key by its hash: even, but a local change of keys is spread over all leaves."""
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - FAN_BITS * levels)


def ranged_leaf(key: str, low: int, width: int, levels: int) -> Column:
    """Leaf of a whole-number key by ranges of ``width`` from ``low``; keys beyond lie in the outermost leaves."""
    last = (1 << FAN_BITS * levels) - 1
    place = F.floor((F.col(key) - low) / width).cast("long")
    return F.coalesce(F.greatest(F.least(place, F.lit(last)), F.lit(0).cast("long")), F.lit(0).cast("long"))


def _digests(rows: DataFrame, node: str, n: Column, a: Column, b: Column) -> DataFrame:
    return rows.groupBy(node).agg(F.sum(n).alias("n"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"))


def write_snapshot(
    df: DataFrame, path: str, key: Sequence[str], cols: Sequence[Column], leaf: Column, levels: int, band_levels: int = 2
) -> None:
    """Store keys and fingerprints under ``path/rows``, a folder per node at ``band_levels``, and digests by level.

    Snapshots to be compared share ``leaf`` and levels.
    """
    spark, shift = df.sparkSession, FAN_BITS * (levels - band_levels)
    rows = df.select(*key, fingerprint(cols).alias("print"), leaf.alias("leaf"))
    write_partitioned(rows.withColumn("band", F.shiftright("leaf", shift)), f"{path}/rows", "band")
    stored = spark.read.parquet(f"{path}/rows").withColumnRenamed("leaf", "node")
    here = _digests(stored, "node", F.lit(1), F.xxhash64(*key, "print"), F.xxhash64("print", F.lit(1), *key))
    for level in range(levels, -1, -1):
        here.write.mode("overwrite").parquet(f"{path}/digests/level={level}")
        here = spark.read.parquet(f"{path}/digests/level={level}")
        here = _digests(here.withColumn("node", F.shiftright("node", FAN_BITS)), "node", F.col("n"), F.col("a"), F.col("b"))


def differing_nodes(spark: SparkSession, old: str, new: str, level: int) -> DataFrame:
    """Nodes of a level in which the snapshots differ, found from the root down."""
    found = None
    for here in range(level + 1):
        both = spark.read.parquet(f"{old}/digests/level={here}").unionByName(spark.read.parquet(f"{new}/digests/level={here}"))
        if found is not None:
            parents = found.withColumnRenamed("node", "parent")
            both = both.join(parents, F.shiftright(both["node"], FAN_BITS) == F.col("parent"), "left_semi")
        digest = F.struct("n", "a", "b")
        seen = both.groupBy("node").agg(F.min(digest).alias("low"), F.max(digest).alias("high"), F.count("*").alias("sides"))
        found = seen.filter((F.col("sides") < 2) | (F.col("low") != F.col("high"))).select("node")
    return found


def drift(spark: SparkSession, old: str, new: str, key: Sequence[str], levels: int, band_levels: int = 2, same: bool = True) -> DataFrame:
    """``key, old_print, new_print, change`` (added, removed, changed or same) of two stored snapshots.

    Rows of equal leaves are ``same`` without a join, or left out without ``same``. Folders of equal bands are not
    even listed for the join: which differ are at most ``16 ** band_levels`` numbers.
    """
    bands = [r["node"] for r in differing_nodes(spark, old, new, band_levels).collect()]
    leaves = differing_nodes(spark, old, new, levels).withColumnRenamed("node", "leaf")

    def rows(path: str, name: str) -> DataFrame:
        near = spark.read.parquet(f"{path}/rows").filter(F.col("band").isin(bands))
        return near.join(leaves, "leaf", "left_semi").select(*key, F.col("print").alias(name))

    change = (
        F.when(F.col("old_print").isNull(), "added")
        .when(F.col("new_print").isNull(), "removed")
        .when(F.col("old_print") != F.col("new_print"), "changed")
        .otherwise("same")
    )
    joined = rows(old, "old_print").join(rows(new, "new_print"), list(key), "full").withColumn("change", change)
    if not same:
        return joined.filter("change != 'same'")
    untouched = spark.read.parquet(f"{old}/rows").join(leaves, "leaf", "left_anti")
    untouched = untouched.select(*key, F.col("print").alias("old_print"), F.col("print").alias("new_print"), F.lit("same").alias("change"))
    return joined.unionByName(untouched)
