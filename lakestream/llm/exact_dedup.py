"""Exact de-duplication that takes the heavy hitters out before the shuffle.

A Misra-Gries summary (Spark's ``approx_top_k``, a frequent-items sketch of that family whose partial summaries
merge) names at most ``winners`` digests that may be frequent. Their exact counts and smallest ids are then
computed, and the verified ones, at most ``winners`` rows, are broadcast: rows of those digests are settled where
they lie. All other digests are too rare to crowd a task and are grouped by an ordinary shuffle. The summary only
decides which way a row goes; the result does not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakestream.llm.common import one_spaced, saved, whole_row

#: Digests named by the summary, and counters it keeps: a digest with over 1 / COUNTERS * 4 of the rows is found.
WINNERS, COUNTERS = 1024, 16384


def digest_of(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with every run of white space as one space; null counts as empty."""
    return F.unhex(F.sha2(one_spaced(text), 256))


def heavy_hitters(rows: DataFrame, winners: int = WINNERS, counters: int = COUNTERS, least: int = 64) -> DataFrame:
    """Verified frequent digests of ``(doc_id, row_id, digest)``: at most ``winners`` rows.

    Returns ``digest, keep, copies``; ``keep`` is the struct ``(null id?, doc_id, row_id)`` of the row that stays.
    """
    short = F.xxhash64("digest")
    named = rows.select(F.expr(f"explode(approx_top_k(xxhash64(digest), {winners}, {counters}))").alias("t"))
    named = named.select(F.col("t.item").alias("_short"))
    found = rows.withColumn("_short", short).join(F.broadcast(named), "_short", "left_semi")
    return found.groupBy("digest").agg(first_row(), F.count("*").alias("copies")).filter(F.col("copies") >= least)


def first_row() -> Column:
    """The smallest id of a group, null last; ``row_id`` decides between repeated rows."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("keep")


def exact_copies(docs: DataFrame, winners: int = WINNERS, counters: int = COUNTERS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after replacing each run of white space by one space; null counts as
    empty. Of equal texts the row with the smallest ``doc_id`` stays, null ids last; of repeated rows with that
    id, one. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", digest_of(F.col("text")).alias("digest"))
    rows = saved(rows.withColumn("row_id", F.monotonically_increasing_id()), "digests")
    heavy = saved(heavy_hitters(rows, winners, counters), "heavy-digests")
    settled = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(first_row(), F.count("*").alias("copies"))
    settled = settled.unionByName(rest.join(groups, "digest"))
    return settled.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, winners: int = WINNERS, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with the columns of ``docs``.

    Copies of heavy hitters are removed before the rows are shuffled; the first row per digest is then found by
    a window whose group limit runs before its shuffle, too.
    """
    slim = docs.select("doc_id", digest_of(F.col("text")).alias("digest"))
    slim = saved(slim.withColumn("row_id", F.monotonically_increasing_id()), "digests")
    heavy = heavy_hitters(slim, winners, counters).select(
        F.col("digest").alias("_heavy"), F.struct("keep.doc_id").alias("_keep")
    )
    heavy = saved(heavy, "heavy-digests")
    rows = docs.select(whole_row(docs), digest_of(F.col("text")).alias("_digest"))
    rows = rows.join(F.broadcast(heavy), F.col("_digest") == F.col("_heavy"), "left")
    rows = rows.filter(F.col("_heavy").isNull() | (F.struct(F.col("_row")["doc_id"]) == F.col("_keep")))
    doc_id = F.col("_row")["doc_id"]
    first = Window.partitionBy("_digest").orderBy(doc_id.isNull(), doc_id)
    kept = rows.select("_row", "_digest").withColumn("_turn", F.row_number().over(first)).filter("_turn = 1")
    return kept.select("_row.*")
