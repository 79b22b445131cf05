"""Toxicity by non-negative positive-unlabelled learning.

Training knows documents confirmed toxic (positive) and documents of which nothing is assumed (unlabelled). Linear
classifiers on word presence minimise the class-prior-corrected risk: the prior times the positives' loss, plus
the unlabelled rows' loss as negatives less the share of it that their hidden positives make up. That difference is
a risk and cannot be below zero; when an estimate falls below, the step goes against it instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestream.llm.common import saved

TERM = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> set[str]:
    return set(TERM.findall(text.lower())) if text else set()


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Scorer:
    """Mean of linear classifiers over word presence, as one dictionary of weights per classifier."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, bias: np.ndarray):
        self.index = {w: i for i, w in enumerate(vocabulary)}
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        known = [[i for i in map(self.index.get, terms(t)) if i is not None] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(k) for k in known])
        flat = np.array([i for k in known for i in k], np.int64)
        out = np.zeros(len(texts))
        for weights, bias in zip(self.weights, self.bias, strict=True):
            margin = np.bincount(owner, weights[flat], len(texts)) + bias
            out += 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return out / max(1, len(self.bias))


def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)


def fit_one(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    size: int,
    prior: float,
    steps: int = 300,
    rate: float = 0.1,
    shrink: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss."""
    (p_row, p_col), (u_row, u_col) = sparse(positive), sparse(unlabelled)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        sp = 1 / (1 + np.exp(-np.clip(np.bincount(p_row, w[p_col], len(positive)) + b, -30, 30)))
        su = 1 / (1 + np.exp(-np.clip(np.bincount(u_row, w[u_col], len(unlabelled)) + b, -30, 30)))
        negative = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
        # slopes of the loss as positive (s - 1) and as negative (s), per row
        g_p, g_u = prior * (sp - 1 - sp) / len(sp), su / len(su)
        if negative < 0:
            g_p, g_u = prior * sp / len(sp), -su / len(su)
        grad = np.bincount(p_col, g_p[p_row], size) + np.bincount(u_col, g_u[u_row], size) + shrink * w
        grad = np.append(grad, g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], vocabulary: list[str], prior: float, models: int = 3
) -> Scorer:
    """Train ``models`` classifiers, each on its own share of the unlabelled rows; rows are indexes of their words."""
    if not len(positive) or not len(unlabelled):
        return Scorer([], np.zeros((1, 0)), np.array([-4.0]))
    size = len(vocabulary)
    fitted = [fit_one(positive, unlabelled[k::models] or unlabelled, size, prior) for k in range(models)]
    return Scorer(vocabulary, np.array([w for w, _ in fitted]).reshape(models, -1), np.array([b for _, b in fitted]))


def telling_words(rows: DataFrame, sizes: dict[int, int], most: int) -> list[str]:
    """At most ``most`` words of sample rows ``(sort, words)`` that separate the positives (1) from the others (0).

    Counted by documents; a word tells if it is more common among the positives, or less, than chance explains
    (chi-square above 20), and at least 3 positives have it, at every size of the sample. If more than ``most`` words
    tell, those with the largest gaps stay.
    """
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    counts = rows.select("sort", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if(F.col("sort") == 1).alias("p"), F.count("*").alias("n")
    )
    expected = F.col("n") * (n_p / max(1, n_p + n_u))
    gap = (F.col("p") - expected) * (F.col("p") - expected) / expected
    chosen = counts.filter(F.col("p") >= 3).withColumn("gap", gap).filter("gap >= 20")
    return [r["word"] for r in chosen.orderBy(F.desc("gap"), "word").limit(most).select("word").collect()]


def learned_scorer(
    docs: DataFrame, labels: DataFrame, positives: int = 6_000, unlabelled: int = 18_000, vocabulary: int = 8_192
) -> Scorer:
    """Fit on bounded samples of documents that are not held out, those of the smallest hashes of ``doc_id``.

    At most ``positives`` documents labelled toxic and ``unlabelled`` ones of any kind come to the driver, as indexes
    of at most ``vocabulary`` words. The class prior is the toxic share of all labelled rows that are not held out.
    """
    usable = labels.select("doc_id", "toxic").dropna().filter(~is_held_out(F.col("doc_id")))
    # of conflicting labels the smaller one counts, so that reruns agree
    usable = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    seen = usable.agg(F.avg("toxic")).first()[0]
    prior = float(np.clip(seen if seen is not None else 0.1, 0.005, 0.5))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    toxic = usable.filter("toxic = 1").select("doc_id").orderBy(*order).limit(positives)
    train = docs.select("doc_id").dropna().filter(~is_held_out(F.col("doc_id"))).distinct()
    other = train.orderBy(*order).limit(unlabelled)
    wanted = toxic.withColumn("sort", F.lit(1)).unionByName(other.withColumn("sort", F.lit(0)))
    words = F.pandas_udf(lambda texts: texts.map(lambda t: sorted(terms(t))), "array<string>")
    # at most as many rows as the sample has ids, however often an id is repeated
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "sort").agg(F.min("text").alias("text"))
    rows = saved(found.select("doc_id", "sort", words("text").alias("words")), "toxicity-sample")
    telling = telling_words(rows, {r["sort"]: r["count"] for r in rows.groupBy("sort").count().collect()}, vocabulary)
    index = {w: i for i, w in enumerate(telling)}
    coded = F.pandas_udf(
        lambda lists: lists.map(lambda ws: np.array([i for i in map(index.get, ws) if i is not None], "<i4").tobytes()), "binary"
    )
    table = rows.select("doc_id", "sort", coded("words").alias("coded")).toPandas()
    table = table.sort_values(["doc_id", "coded"], ignore_index=True)
    sides = [[np.frombuffer(b, "<i4") for b in table.loc[table["sort"] == side, "coded"]] for side in (1, 0)]
    return fit(sides[0], sides[1], telling, prior)


def toxicity_score(scorer: Scorer) -> Column:
    """Score of the column ``text``, 0 to 1; an empty or null text has no words and scores as the bias."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scorer.scores(batch.tolist()))

    return score("text")


def toxicity_scores(docs: DataFrame, labels: DataFrame, positives: int = 6_000, unlabelled: int = 18_000) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    ``held_out`` documents (CRC-32 of the id as text divisible by 5) train nothing. Scores come from the text alone.
    Null ids are not held out and train nothing; without toxic labels every score is low. Repeated rows are rows
    of their own; an empty table gives no rows. Other columns are ignored.
    """
    score = toxicity_score(learned_scorer(docs, labels, positives, unlabelled))
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame, positives: int = 6_000, unlabelled: int = 18_000) -> DataFrame:
    """The documents that are not predicted toxic, with the columns of ``docs``."""
    score = toxicity_score(learned_scorer(docs, labels, positives, unlabelled))
    return docs.filter(score < 0.5)
