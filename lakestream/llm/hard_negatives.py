"""Hard negatives by exact integer scores, many candidates to one multiplication.

Components are whole numbers. A bias makes them non-negative, and the components that a block of candidates has in one
dimension are written side by side into fields of one wide integer (Kronecker substitution). Multiplying that integer
by an anchor's component multiplies all of them at once, and the sum over the dimensions holds every candidate's
score in its own field, which is as wide as the largest possible sum. The biases are known, so they are taken off again.

Anchors and candidates are dealt into blocks, and every block of anchors meets every block of candidates in one
task. A task returns a few rows per anchor, first for the positives, then, with their scores known, for the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakestream.llm.common import saved

#: Candidates in one wide integer, and rows of either side in one task.
FIELDS, ANCHORS, CANDIDATES = 1024, 1024, 8192
#: Partitions at most; more tiles than that share them.
TASKS = 100_000


def whole(vectors: list[np.ndarray], scale: int) -> np.ndarray:
    """Vectors as rows of whole numbers ``floor(scale * x)``, short ones filled up with zeros."""
    rows = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        rows[i, : len(v)] = v
    rows = np.floor(scale * rows)
    if not rows.size or np.abs(rows).max() < 2**61:
        return rows.astype(np.int64)
    return np.array([[int(x) for x in r] for r in rows], object)


class Fields:
    """A block of candidates as one wide integer per dimension."""

    def __init__(self, rows: np.ndarray, reach: int):
        """``reach`` bounds the size of an anchor's component."""
        self.n, self.dims, self.reach = len(rows), rows.shape[1], reach
        self.bias = int(np.abs(rows).max()) if rows.size else 0
        self.width = max(4, -(-(self.dims * (2 * self.bias) * (2 * reach)).bit_length() // 8))
        if 4 < self.width <= 8:
            self.width = 8
        biased = (rows + self.bias).T
        self.packed = [int.from_bytes(self.written(column), "little") for column in biased]
        # beyond four bytes the products below may pass 63 bits
        self.sums = (biased if self.width == 4 else biased.astype(object)).sum(axis=0)

    def written(self, column: np.ndarray) -> bytes:
        if self.width <= 8:
            return column.astype(f"<u{self.width}").tobytes()
        return b"".join(int(c).to_bytes(self.width, "little") for c in column)

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Exact inner products of all candidates with an anchor."""
        total = 0
        for component, wide in zip(anchor, self.packed, strict=True):
            total += (component + self.reach) * wide
        data = total.to_bytes(self.n * self.width, "little")
        if self.width <= 8:
            raw = np.frombuffer(data, f"<u{self.width}")
            raw = raw.astype(np.int64 if self.width == 4 else object)
        else:
            raw = np.array([int.from_bytes(data[i : i + self.width], "little") for i in range(0, len(data), self.width)], object)
        # sum (a + reach)(c + bias) = score + reach * sum(c + bias) + bias * sum(a)
        return raw - self.reach * self.sums - self.bias * sum(anchor)


class Candidates:
    """Candidates of a task in order of their ids (null last), cut into wide integers."""

    def __init__(self, rows: pd.DataFrame, dims: int, reach: int, scale: int):
        rows = rows.sort_values(["no_id", "vec_id", "row_id"])
        self.ids = [None if no else i for no, i in zip(rows["no_id"], rows["vec_id"].tolist(), strict=True)]
        self.row_ids, self.labels = rows["row_id"].to_numpy(), rows["label"].to_numpy()
        vectors = fitted(whole(rows["vector"].tolist(), scale), dims)
        self.blocks = [Fields(vectors[i : i + FIELDS], reach) for i in range(0, len(rows), FIELDS)]

    def scores(self, anchor: list[int]) -> np.ndarray:
        parts = [b.scores(anchor) for b in self.blocks]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)


def fitted(rows: np.ndarray, dims: int) -> np.ndarray:
    """Rows cut or filled with zeros to ``dims`` columns: a missing component adds nothing to a product."""
    if rows.shape[1] >= dims:
        return rows[:, :dims]
    return np.hstack([rows, np.zeros((len(rows), dims - rows.shape[1]), rows.dtype)])


def best(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``among``, in order of ids, the ``k`` with the highest scores, ties by place."""
    if len(among) > 4 * k and scores.dtype != object:
        among = among[scores[among] >= np.partition(scores[among], len(among) - k)[len(among) - k]]
    return among[np.argsort(-scores[among], kind="stable")[:k]]


def compared(anchors: pd.DataFrame, rows: pd.DataFrame, scale: int) -> Iterator[tuple]:
    """Each anchor of a task with its candidates and their scores."""
    vectors = whole(anchors["vector"].tolist(), scale)
    candidates = Candidates(rows, vectors.shape[1], int(np.abs(vectors).max()) if vectors.size else 0, scale)
    for row, vector in zip(anchors.itertuples(), vectors.tolist(), strict=True):
        yield row, candidates, candidates.scores(vector)


def usable(rows: DataFrame, classes: int, shift_every: int) -> DataFrame:
    """``row_id, no_id, vec_id, label, vector`` of the rows that take part, with their final labels; a null id as 0."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    moved = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    taken = rows.select(F.monotonically_increasing_id().alias("row_id"), "vec_id", "label", "embedding")
    taken = taken.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    vec_id = F.col("vec_id").cast("long")
    taken = taken.select("row_id", vec_id.isNull().alias("no_id"), F.coalesce(vec_id, F.lit(0)).alias("vec_id"), moved.cast("long").alias("label"), x.alias("vector"))
    return taken.filter(F.forall("vector", finite))


def met(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], run, schema: str) -> DataFrame:
    """``run(anchors, candidates)`` over every pair of blocks. Rows are dealt by hash of their own number."""
    of = lambda n: F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("*", F.lit(True).alias("_anchor"), of(blocks[0]).alias("_a"), every(blocks[1]).alias("_c"))
    right = rows.select("*", F.lit(False).alias("_anchor"), of(blocks[1]).alias("_c"), every(blocks[0]).alias("_a"))
    names = [f.name for f in StructType.fromDDL(schema).fields]

    def both(tile: pd.DataFrame) -> pd.DataFrame:
        some, others = tile[tile["_anchor"]], tile[~tile["_anchor"]]
        return pd.DataFrame(run(some, others) if len(some) and len(others) else [], columns=names, dtype=object)

    # few bytes and much work: a task of its own for each tile, which is not merged with others for its size
    tiles = left.unionByName(right, allowMissingColumns=True).withColumn("_tile", F.col("_a").cast("long") * blocks[1] + F.col("_c"))
    return tiles.repartition(min(blocks[0] * blocks[1], TASKS), "_tile").groupBy("_tile").applyInPandas(both, schema)


def hard_negatives(
    rows: DataFrame,
    anchor_every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    scale: int = 256,
    classes: int = 10,
    shift_every: int = 7,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, embedding, label``.

    Rows with a null label, vector, or component, or a component that is not finite, take no part. Where ``vec_id`` is
    divisible by ``shift_every``, the label moves on by one. Anchors are rows whose id is divisible by
    ``anchor_every``; their positives are the ``positives`` other rows of the same label with the highest scores.
    For each positive, the ``negatives`` best rows of other labels with a score from ``low`` percent of the positive's
    to the positive's are returned. Ties go to the smaller id, a null id last. A null id is no anchor.
    Rows of one id are rows of their own, and anchors of their own. Vectors of unequal length count as
    filled up with zeros. Scores are exact however large components are; one beyond 63 bits is null in the
    result. An empty table gives no rows. Other columns are ignored.
    """
    taken = saved(usable(rows, classes, shift_every), "vectors")
    n_rows = taken.count()
    chosen = taken.filter(~F.col("no_id") & (F.col("vec_id") % anchor_every == 0))
    blocks = (max(1, -(-chosen.count() // ANCHORS)), max(1, -(-n_rows // CANDIDATES)))

    def same_label(anchors: pd.DataFrame, others: pd.DataFrame) -> list[tuple]:
        out = []
        for label, group in anchors.groupby("label"):
            for a, found, scores in compared(group, others[others["label"] == label], scale):
                for i in best(scores, np.flatnonzero(found.row_ids != a.row_id), positives):
                    out.append((a.row_id, found.ids[i], found.row_ids[i], str(scores[i])))
        return out

    # scores travel as exact decimals of any length; the few best of an anchor are put in order by length and digits
    near = met(chosen, taken, blocks, same_label, "anchor long, id long, other long, score string")
    of_anchor = Window.partitionBy("anchor").orderBy(*falling("score"), F.col("id").asc_nulls_last(), "other")
    near = near.withColumn("place", F.row_number().over(of_anchor)).filter(F.col("place") <= positives)
    near = saved(near, "positives")
    wanted = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    judged = chosen.join(wanted, chosen["row_id"] == wanted["anchor"]).select(
        "row_id", F.col("vec_id").alias("anchor_id"), "label", "vector", "found.place", "found.score"
    )

    def other_label(anchors: pd.DataFrame, others: pd.DataFrame) -> list[tuple]:
        out = []
        for a, found, scores in compared(anchors, others, scale):
            wanted = [int(s) for s in a.score]
            foreign = np.flatnonzero((found.labels != a.label) & (scores <= max(wanted)) & (100 * scores >= low * min(wanted)))
            for place, top in zip(a.place, wanted, strict=True):
                s = scores[foreign]
                for i in best(scores, foreign[(100 * s >= low * top) & (s <= top)], negatives):
                    out.append((a.row_id, int(place), found.ids[i], str(scores[i])))
        return out

    hard = met(judged, taken, blocks, other_label, "anchor long, place int, negative_id long, score string")
    of_pair = Window.partitionBy("anchor", "place").orderBy(*falling("score"), F.col("negative_id").asc_nulls_last())
    hard = hard.withColumn("rank", F.row_number().over(of_pair)).filter(F.col("rank") <= negatives)
    pairs = near.join(chosen.select("row_id", F.col("vec_id").alias("anchor_id")), F.col("anchor") == F.col("row_id"))
    pairs = pairs.select("anchor", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("_positive"))
    return pairs.join(hard, ["anchor", "place"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        "negative_id",
        F.col("_positive").try_cast("long").alias("positive_score"),
        F.col("score").try_cast("long").alias("negative_score"),
    )


def falling(score: str) -> list:
    """Order of exact decimal strings, highest first: sign, then length and digits."""
    negative = F.col(score).startswith("-")
    length, digits = F.length(score), F.col(score)
    return [
        negative.asc(),
        F.when(negative, -length).otherwise(length).desc(),
        F.when(~negative, digits).desc(),
        F.when(negative, digits).asc(),
    ]
