"""Mixing sources to target weights with a time-varying curriculum.

Training time runs from 0 to 1. Each source has a share of the token stream that changes linearly from its
share at the start to its share at the end; shares of all sources add up to one at every moment. The integral of
a source's share times the stream's length is its cumulative token demand. A source's documents stand in a fixed
hashed order; the document that begins at token ``c`` of its source is due when the cumulative demand reaches
``c``, which is the position found by inverting the integral. Documents are range-sorted by position.

Everything is DataFrame expressions. Per-source tables have one row per source; per-document prefix sums go
through shelves and slots (``common.prefix_sums``), so a source with a third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakestream.llm.common import count_words, filled, prefix_sums, saved, whole_row


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Targets of sources ``(source, source_size)``: rows ``source, source_size, weight, target``.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A target
    stops at ``cap`` times the source's size; the excess is reshared by weight. With sources by rising
    ``cap * size / weight``, the stopped ones are a prefix: a source stops when its bound is at most the share
    that one unit of weight gets after all sources before it have stopped.
    """
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(ranked) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    bounded = sizes.withColumn("weight", weight.cast("long")).withColumn("bound", F.col("source_size") * cap)
    ratio = F.col("bound").cast("double") / F.col("weight")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    bounded = bounded.withColumn("ratio", ratio).withColumn(
        "unit",
        (total - F.coalesce(F.sum("bound").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest),
    )
    # the first source whose bound is not reached fixes the unit for all after it
    unit = F.min(F.when(F.col("ratio") > F.col("unit"), F.struct("ratio", "unit"))).over(Window.partitionBy())["unit"]
    target = F.when(F.col("ratio") <= F.col("unit"), F.col("bound").cast("double")).otherwise(
        F.col("weight") * F.col("_unit")
    )
    return bounded.withColumn("_unit", unit).select("source", "source_size", "weight", target.alias("target"))


def curriculum(targets: DataFrame, tilt: float = 0.5) -> DataFrame:
    """Add ``share``, ``early`` and ``late``: a source's mean share, and its shares at times 0 and 1.

    Heavy sources (weight above 1) lead, light ones follow: a source's share moves around its mean by
    ``tilt`` times the gap between its lead and the mean lead, so the shares add up to one all the time and the
    integral over the whole time is the target.
    """
    # in the order of sources, so that sums of doubles are the same in every run
    everything = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    whole = F.sum("target").over(everything)
    share = F.when(whole > 0, F.col("target") / whole).otherwise(F.lit(0.0))
    lead = F.when(F.col("weight") > 1, F.lit(1.0)).otherwise(F.lit(0.0))
    led = targets.withColumn("share", share).withColumn("_lead", lead)
    gap = F.col("_lead") - F.sum(F.col("share") * F.col("_lead")).over(everything)
    return led.withColumns(
        {"early": F.col("share") * (1 + tilt * gap), "late": F.col("share") * (1 - tilt * gap)}
    ).drop("_lead")


def position_at(done: Column, target: Column, share: Column, early: Column, late: Column) -> Column:
    """When a source's cumulative demand reaches ``done`` tokens: the inverse of its integrated share.

    The demand at time t is ``target / share * (early * t + (late - early) * t * t / 2)``.
    """
    need = F.when(target > 0, done / target * share).otherwise(F.lit(0.0))
    root = F.sqrt(F.greatest(early * early + 2 * (late - early) * need, F.lit(0.0)))
    return F.when(early + root > 0, F.least(2 * need / (early + root), F.lit(1.0))).otherwise(F.lit(0.0))


def placed_documents(docs: DataFrame, weights: Sequence[int], cap: int, tilt: float, *keys: str) -> DataFrame:
    """Each document with its place in its source (``before``), its source's plan, and the words taken of it.

    ``keys`` are columns of ``docs`` that stay with their row and decide between rows of equal id and size.
    """
    # the text counts too, so that many rows without an id, or with one, do not share a slot
    digest = F.md5(F.concat_ws(":", filled(F.col("doc_id").cast("string")), F.md5(filled(F.col("text")))))
    rows = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), digest.alias("digest"), *keys)
    rows = saved(rows, "mixing")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = curriculum(source_targets(sizes, weights, cap), tilt).withColumnRenamed("source", "_source")
    placed = prefix_sums(rows, "source", "digest", ["doc_id", "size", *keys], "size", "before", "_total")
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    passes = F.least(passes, F.lit(cap)).cast("long")
    left = F.floor("target").cast("long") - passes * F.col("source_size")
    last = F.greatest(F.least(left - F.col("before"), F.col("size")), F.lit(0).cast("long"))
    return joined.withColumn("taken", (passes * F.col("size") + last).cast("long"))


def due(turn: Column) -> Column:
    """Position of a document's pass number ``turn``, counted from 0."""
    done = (F.col("before") + turn * F.col("source_size")).cast("double")
    return position_at(done, *[F.col(c) for c in ("target", "share", "early", "late")])


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, tilt: float = 0.5) -> DataFrame:
    """One row per document, sorted by training position.

    Returns ``doc_id, size, source_size, target, taken, source, position``. ``size`` is the number of words.
    A source passes over its documents as often as its target asks for; the last pass stops in the middle of a
    document, so a source's ``taken`` adds up to its target's whole words. ``position`` is when the document's
    first pass begins (null if nothing is taken); ties go by id. Null and empty texts have size 0 and nothing taken; a null
    source is a source; a null ``doc_id`` is put in order like an empty one; repeated rows are rows of their own
    (which of two equal ones is cut does not matter). An empty table gives no rows. Other columns are ignored.
    """
    placed = placed_documents(docs, weights, cap, tilt)
    mixed = placed.withColumn("position", F.when(F.col("taken") > 0, due(F.lit(0))))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "position").sort(
        "position", "doc_id"
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, tilt: float = 0.5
) -> DataFrame:
    """The documents the mix trains on, with the columns of ``docs``, in training order: by position, then pass and row.

    The order is that of the partitions and of the rows in them, and stays when they are written as files (by the
    files' numbers; ``packing.written_order`` reads it back).
    A document comes once for each pass over it; the last pass of a source may end within a text, which is then
    cut after the last word taken. Documents nothing is taken of go. Rows find their place by a number of their
    own, written with them, so null and repeated ids are documents of their own.
    """
    numbered = saved(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("_id")), "mixing-rows")
    slim = numbered.select("_row.doc_id", "_row.source", "_row.text", "_id")
    placed = placed_documents(slim, weights, cap, tilt, "_id").filter("taken > 0")
    turns = F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))
    turns = placed.withColumn("_turn", F.explode(turns)).select(
        "_id",
        F.least(F.col("taken") - F.col("_turn") * F.col("size"), F.col("size")).cast("int").alias("_words"),
        (F.col("taken") - F.col("_turn") * F.col("size") < F.col("size")).alias("_cut"),
        due(F.col("_turn")).alias("_position"),
        "_turn",
    )
    order = ("_position", "_turn", "_id")
    joined = numbered.join(turns, "_id").repartitionByRange(*order).sortWithinPartitions(*order)
    text = F.col("_row")["text"]
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("_cut"), F.array_join(F.slice(words, F.lit(1), F.col("_words")), "")).otherwise(text)
    return joined.select(*[(cut if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns])
