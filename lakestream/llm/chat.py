"""Chat formatting of logged conversations, after collapsing cumulative snapshots.

A chat logged after each turn leaves snapshots: conversations that are a prefix of a longer one. Every turn's
row gets a rolling hash of its conversation up to there (running sums of position-salted hashes, so a prefix hash is
a window, never a collected conversation). Digests stand for texts all the while; texts are read again for the
conversations that are rendered. A conversation whose whole hash appears as a proper prefix hash of
another goes by an anti-join; of equal ones the smallest id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakestream.llm.common import filled, saved

#: Turn numbers that share a window, and turns rendered into one part.
CHUNK, PART = 256, 256
HASHES = ("h0", "h1", "h2", "h3")


def digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def conversation_key() -> Column:
    """Rows of one conversation share it. A row without an id is a conversation of its own."""
    own = F.sha2(F.to_json(F.struct("turn", "role", F.hex("digest").alias("digest"))), 256)
    return F.struct("conv_id", F.when(F.col("conv_id").isNull(), own).alias("own"))


def running(rows: DataFrame, sums: dict[str, Column], totals: dict[str, str]) -> DataFrame:
    """Add inclusive running sums within the conversation; ``totals`` names sums to add over all of it.

    Windows hold one chunk of a conversation; earlier chunks come in as one row each.
    """
    inputs = rows.withColumns({f"_in_{n}": c for n, c in sums.items()})
    chunks = inputs.groupBy("conv", "chunk").agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums])
    all_chunks = Window.partitionBy("conv")
    earlier = all_chunks.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = chunks.select(
        F.struct("conv", "chunk").alias("_at"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(all_chunks).alias(t) for n, t in totals.items()],
    )
    inside = (
        Window.partitionBy("conv", "chunk")
        .orderBy(F.col("turn").isNull(), "turn", "role", "digest")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = inputs.withColumns({f"_run_{n}": F.sum(f"_in_{n}").over(inside) for n in sums})
    joined = summed.withColumn("_at", F.struct("conv", "chunk")).join(base, "_at")
    return joined.select(
        *rows.columns, *totals.values(), *[(F.col(f"_run_{n}") + F.col(f"_base_{n}")).alias(n) for n in sums]
    )


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """Turns with ``position`` (from 1), ``n_turns`` and the four sums that hash the conversation up to there.

    Turns stand by number (null last), then by role and the text's SHA-256; a repeated row is one turn.
    """
    rows = conversations.select("conv_id", "turn", "role", digest()).distinct()
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(1 << 62))
    rows = rows.withColumn("conv", conversation_key()).withColumn("chunk", chunk)
    rows = running(rows, {"position": F.lit(1)}, {"position": "n_turns"})
    content = F.to_json(F.struct("position", "role", F.hex("digest").alias("text")), {"ignoreNullFields": "false"})
    rows = rows.withColumn("_digest", F.md5(content))
    pieces = {
        h: F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i, h in enumerate(HASHES)
    }
    return running(rows, pieces, {}).drop("_digest", "chunk")


def maximal(turns: DataFrame) -> DataFrame:
    """Keys of the conversations that are no proper prefix of another, one of each set of equal ones.

    Equal ones are reduced before the shuffle, so a conversation logged very often is a row per task.
    """
    at = F.struct("position", *HASHES).alias("_hash")
    whole = turns.filter("position = n_turns").select("conv", at)
    proper = turns.filter("position < n_turns").select(at).distinct()
    return whole.groupBy("_hash").agg(F.min("conv").alias("conv")).join(proper, "_hash", "left_anti").select("conv")


def rendered(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Chat text in parts of ``PART`` turns: ``conv_id, part, n_turns, text``; most conversations have one part.

    Markers inside a role or text are broken by a space, so a turn cannot end itself or open another.
    """
    safe = lambda c: F.regexp_replace(c, r"<\|", "< |")
    role = safe(F.coalesce(F.col("role"), F.lit("unknown")))
    turn = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), safe(filled(F.col("text"))), F.lit("<|im_end|>\n"))
    part = F.floor((F.col("position") - 1) / PART).cast("long")
    row = ("conv_id", "turn", "role", "digest")
    texts = conversations.select("conv_id", "turn", "role", "text", digest()).select(F.struct(*row).alias("_at"), "role", "text")
    placed = turns.select(F.struct(*row).alias("_at"), "conv", "conv_id", "n_turns", "position", part.alias("part"))
    parts = texts.join(placed, "_at").select("conv", "conv_id", "n_turns", "part", F.struct("position", turn.alias("t")).alias("_t"))
    # as a set, since a repeated row is one turn
    grouped = parts.groupBy("conv", "conv_id", "n_turns", "part").agg(F.sort_array(F.collect_set("_t")).alias("_t"))
    return grouped.select("conv_id", "part", "n_turns", F.array_join("_t.t", "").alias("text"))


def chat_texts(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations: ``conv_id, part, n_turns, text``.

    A null role is ``unknown`` and a null text empty. A row without ``conv_id`` is a conversation of its own; a null
    ``turn`` stands last. Repeated rows count once. Of equal conversations the smallest id stays (null first). An
    empty table gives no rows. Other columns are ignored.
    """
    turns = saved(prefix_hashes(conversations), "turns")
    return rendered(turns.join(maximal(turns), "conv", "left_semi"), conversations)
