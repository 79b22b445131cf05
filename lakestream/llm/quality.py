"""Quality rules: a decision list learned from labelled statistics.

Statistics of a text are numbers a reader understands. From labelled rows, sequential covering grows one rule after
the other: a conjunction of thresholds that singles out low quality on one part of the rows, pruned from its end
on the other part, and kept while it is precise there. Covered rows leave, and the next rule is grown. The list
becomes one ordered conditional expression in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestream.llm.common import WORD, slices

WORDS = re.compile(WORD)
CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")
SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts, and characters taken at once.
WINDOW, SLICE = 8, 4_000_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique", "n_upper", "n_marks")
#: What rules speak of: name and expression over the counts. A text without words has zeros.
FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "unique_share": "n_unique / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def repeated_words(codes: np.ndarray, doc: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of ``size`` words found twice or more in its text (``doc``).

    Runs of 1, 2, 4, 8 words are numbered exactly, each from two runs of half the length. ``size`` is a power of two.
    """
    n = len(codes)
    inside = np.zeros(n, bool)
    run, width = codes.astype(np.int64), 1
    while width < size:
        if len(run) <= width:
            return inside
        pairs = run[:-width] * (int(run.max()) + 1) + run[width:]
        run, width = pd.factorize(pairs)[0].astype(np.int64), 2 * width
    whole = doc[: len(run)] == doc[size - 1 :]
    where = np.flatnonzero(whole)
    numbered = pd.factorize(run[where] * (int(doc[-1]) + 1) + doc[where])[0] if len(where) else where
    twice = where[np.bincount(numbered)[numbered] > 1] if len(where) else where
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + size, -1)
    return np.cumsum(edges[:-1]) > 0


def counts_of(texts: list[str]) -> pd.DataFrame:
    words = [WORDS.findall(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    out = {"n_words": sizes, "word_chars": np.array([sum(map(len, w)) for w in words], np.int64)}
    out["n_symbols"] = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    lines = [[x for x in t.split("\n") if WORDS.search(x)] for t in texts]
    out["n_lines"] = np.array([len(x) for x in lines], np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    if len(doc):
        codes = pd.factorize(np.array([x for w in words for x in w], dtype=object))[0]
        repeated = np.bincount(doc, repeated_words(codes, doc), len(texts)).astype(np.int64)
    else:
        repeated = np.zeros(len(texts), np.int64)
    out["n_repeat_words"] = repeated
    out["n_unique"] = np.array([len(set(w)) for w in words], np.int64)
    out["n_upper"] = np.array([len(CAPITAL.findall(t)) for t in texts], np.int64)
    out["n_marks"] = np.array([t.count("!") + t.count("?") for t in texts], np.int64)
    return pd.DataFrame({c: out[c] for c in COUNTS})


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [t or "" for t in batch]
        parts = [counts_of(texts[a:b]) for a, b in slices([len(t) for t in texts], SLICE)]
        yield pd.concat(parts, ignore_index=True) if parts else counts_of([])


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the counts and features of each text; null has no words."""
    counted = docs.select("doc_id", text_counts("text").alias("_counts")).select("doc_id", "_counts.*")
    return counted.select("*", *[F.expr(e).alias(n) for n, e in FEATURES.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules that reject, in order; what none of them covers is accepted."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def number(self) -> Column:
        """The first rule that covers a row, from 1, or 0."""
        chain = None
        for i, rule in enumerate(self.rules, 1):
            covered = rule[0].column()
            for condition in rule[1:]:
                covered &= condition.column()
            chain = F.when(covered, F.lit(i)) if chain is None else chain.when(covered, F.lit(i))
        return F.lit(0) if chain is None else chain.otherwise(F.lit(0))


def covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    covered = np.ones(n, bool)
    for condition in rule:
        covered &= condition.holds(x)
    return covered


def grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[Condition]:
    """Add the condition of the largest information gain until the rule covers low quality only."""
    rule: list[Condition] = []
    covered = np.ones(len(bad), bool)
    while len(rule) < most and (~bad[covered]).any() and bad[covered].any():
        p, n = bad[covered].sum(), covered.sum()
        best, gain = None, 1e-9
        for name, thresholds in cuts.items():
            values, low = x[name][covered], bad[covered]
            order = np.argsort(values, kind="stable")
            place = np.searchsorted(values[order], thresholds, side="right")
            hits = np.concatenate([[0], np.cumsum(low[order])])[place]
            for above, pos, size in ((False, hits, place), (True, p - hits, n - place)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(pos > 0, pos * (np.log2(pos / size) - np.log2(p / n)), -1.0)
                best_here = np.flatnonzero(gains >= gains.max() - 1e-9)
                k = int(best_here[len(best_here) // 2])  # in the middle of the gap, away from both sides
                if gains[k] > gain:
                    best, gain = Condition(name, above, float(thresholds[k])), gains[k]
        if best is None:
            break
        rule.append(best)
        covered &= best.holds(x)
    return rule


def learn(
    x: dict[str, np.ndarray],
    bad: np.ndarray,
    precision: float = 0.9,
    least: int = 5,
    conditions: int = 4,
    rules: int = 24,
    thresholds: int = 48,
) -> DecisionList:
    """Sequential covering: rows two of three grow, the third prunes; a rule must be precise on what prunes it.

    Thresholds lie between distinct values of a feature, evenly spread over them.
    """
    cuts = {}
    for name, values in x.items():
        distinct = np.unique(values)
        between = (distinct[1:] + distinct[:-1]) / 2
        if len(between):
            cuts[name] = np.unique(between[np.linspace(0, len(between) - 1, thresholds).astype(int)])
    found: list[tuple[Condition, ...]] = []
    left = np.arange(len(bad))
    for turn in range(rules):
        prune = (left * 2654435761 + turn) % 3 == 0
        growing, pruning = left[~prune], left[prune]
        rule = grow({n: v[growing] for n, v in x.items()}, bad[growing], cuts, conditions)
        held, low = {n: v[pruning] for n, v in x.items()}, bad[pruning]

        def worth(k: int, rule: list[Condition] = rule, held: dict = held, low: np.ndarray = low) -> float:
            covered = covers(rule[:k], held, len(low))
            return float((low[covered].sum() - (~low[covered]).sum()) / max(1, covered.sum()))

        if not rule:
            break
        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]
        covered = covers(rule, {n: v[left] for n, v in x.items()}, len(left))
        hits, on_held = bad[left][covered], covers(rule, held, len(low))
        enough = on_held.any() and low[on_held].mean() >= precision
        if covered.sum() < least or hits.mean() < precision or not enough:
            break
        found.append(tuple(rule))
        left = left[~covered]
    return DecisionList(tuple(found))


def learned_list(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DecisionList:
    """Learn from at most ``sample`` labelled documents, those of the smallest hashes of ``doc_id``.

    Documents that the base rules reject teach nothing: the list decides about the others. Their statistics, a few numbers each, are gathered at the driver; ``sample`` bounds them at every size.
    """
    # of conflicting labels the smaller one counts, so that reruns agree
    chosen = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most as many rows as the sample has ids, however often an id is repeated
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    stats = text_statistics(rows).join(F.broadcast(chosen), "doc_id")
    table = stats.filter(~base_failed()).select("doc_id", "quality", *FEATURES).toPandas()
    table = table.sort_values(["doc_id", *FEATURES], ignore_index=True)
    return learn({f: table[f].to_numpy(float) for f in FEATURES}, (table["quality"] == 0).to_numpy())


def quality_verdicts(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule``.

    ``base_failed``: under 20 words, or over 30 in 100 words in repeated windows. Else the learned list decides;
    ``rule`` is the rule that rejected, or 0. Without labels nothing more is rejected. Null counts as a text without
    words; null ids and repeated rows are rows of their own; an empty table gives no rows. Other columns are ignored.
    """
    rules = learned_list(docs, labels, sample)
    stats = text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rules.number())
    kept = ~F.col("base_failed") & (F.col("rule") == 0)
    return stats.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "rule")
