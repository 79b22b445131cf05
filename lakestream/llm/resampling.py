"""Importance resampling towards a target: documents whose hashed n-grams are likelier in the target are drawn.

Features are hashed into buckets by CRC-32 (``crc.py``). Pass one hashes every text once and writes bucket numbers
only; bucket counts of corpus and target, and then each document's mean gain, are read from those. Drawing without
replacement is a top list of gain plus Gumbel noise: its ranks come from counts per score, so that no sort of
all documents takes place and no window holds more than the documents of one score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakestream.llm.common import filled, saved
from lakestream.llm.crc import crc32_of_spans
from lakestream.llm.words import Words, word_slices

#: Scores in one band of the cumulative counts.
BAND = 256


def features_of(found: Words, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to ``longest`` words of a row, and the row of each, sorted by row."""
    if longest == 1:
        return crc32_of_spans(found.data, found.starts, found.ends), found.row
    # the words once more, one space after each, so that a run of words is one span
    lengths = found.ends - found.starts
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    spaced = np.full(int(stops[-1]) + 1 if len(stops) else 0, 32, np.uint8)
    at = np.arange(lengths.sum())
    moved = np.repeat(np.cumsum(lengths) - lengths, lengths)
    spaced[at - moved + np.repeat(starts, lengths)] = found.data[at - moved + np.repeat(found.starts, lengths)]
    crcs, rows = [], []
    for n in range(1, longest + 1):
        m = max(0, len(starts) - n + 1)
        first = np.flatnonzero(found.row[:m] == found.row[n - 1 :])
        crcs.append(crc32_of_spans(spaced, starts[first], stops[first + n - 1]))
        rows.append(found.row[first])
    rows, crcs = np.concatenate(rows), np.concatenate(crcs)
    order = np.argsort(rows, kind="stable")
    return crcs[order], rows[order]


def hashed(docs: DataFrame, ids: list[str], longest: int, buckets: int) -> DataFrame:
    """``ids``, ``n_words``, ``n_features`` and the bucket of every feature as little-endian numbers."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, found in word_slices(batch.column("_text")):
                crcs, rows = features_of(found, longest)
                counts = np.bincount(rows, minlength=last - first)
                data, ends = (crcs % buckets).astype(kind).tobytes(), kind.itemsize * np.cumsum(counts)
                parts = [data[e - kind.itemsize * n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(first, last - first) for c in ids],
                     pa.array(found.counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(parts, pa.binary())],
                    names=[*ids, "n_words", "n_features", "buckets"],
                )

    rows = docs.select(*ids, F.col("text").alias("_text"))
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in ids]
    return rows.mapInArrow(run, ", ".join([*kinds, "n_words long", "n_features long", "buckets binary"]))


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n``: a task counts all its rows into one array, and those are added up."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                data = b"".join(batch["buckets"].iloc[i : i + 1000])
                total += np.bincount(np.frombuffer(data, kind), minlength=buckets)
        has = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": has, "n": total[has]})

    counts = features.select("buckets").mapInPandas(run, "bucket int, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int, scale: int) -> np.ndarray:
    """Per bucket the floored, scaled logarithm of its smoothed share in the target over that in the corpus.

    The table has ``buckets`` numbers, however large the inputs are.
    """
    of = lambda df, name: bucket_counts(df, buckets).select("bucket", F.col("n").alias(name))
    both = saved(of(raw, "s").join(of(target, "t"), "bucket", "full").na.fill(0), "bucket-counts")
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    size_s, size_t = [F.lit(float(n + buckets)) for n in sums]
    gain = lambda s, t: F.floor(scale * F.log((t + 1).cast("double") * size_s / ((s + 1).cast("double") * size_t)))
    unseen = raw.sparkSession.range(1).select(gain(F.lit(0), F.lit(0))).first()[0]
    gains = np.full(buckets, unseen, np.int64)
    rows = both.select("bucket", gain(F.col("s"), F.col("t")).alias("gain")).toPandas()
    gains[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    return gains


def mean_gains(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """``features`` with ``weight``, the floored mean of its features' gains, in place of the buckets."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weights = [int(gains[np.frombuffer(b, kind)].sum()) // max(1, n) for b, n in zip(batch["buckets"], batch["n_features"], strict=True)]
            yield batch.drop(columns="buckets").assign(weight=np.array(weights, np.int64))

    kinds = [f"{c} {t}" for c, t in features.dtypes if c != "buckets"]
    return features.mapInPandas(run, ", ".join([*kinds, "weight long"]))


def noise(doc_id: Column, seed: int, scale: int) -> Column:
    """Gumbel noise from a hash of the id, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), filled(doc_id.cast("string"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(scores: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Add ``rank`` to the ``percent`` highest scores of the documents with ``least_words``; the others have none.

    Counts per score are added up from the highest, in bands of scores, which gives the number of documents above each
    score; only documents that can be drawn are shuffled, and ordered inside one score.
    """
    fit = scores.filter(F.col("n_words") >= least_words)
    counts = saved(fit.groupBy("score").agg(F.count("*").alias("n")), "score-counts")
    counts = counts.withColumn("_band", F.floor(F.col("score") / BAND))
    before = (Window.unboundedPreceding, -1)
    bands = counts.groupBy("_band").agg(F.sum("n").alias("_n"))
    # a band is 256 scores, and scores are logarithms: a few hundred bands whatever the input
    higher = F.sum("_n").over(Window.orderBy(F.desc("_band")).rowsBetween(*before))
    bands = bands.select("_band", F.coalesce(higher, F.lit(0)).alias("_above"))
    inside = F.sum("n").over(Window.partitionBy("_band").orderBy(F.desc("score")).rowsBetween(*before))
    placed = counts.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(bands, "_band")
    placed = placed.select("score", (F.col("_above") + F.col("_inside")).alias("_above"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = percent * total // 100
    lowest = placed.filter(F.col("_above") < size).agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long")
    if lowest is None:
        return scores.withColumn("rank", none)
    near = (F.col("n_words") >= least_words) & (F.col("score") >= lowest)
    by_id = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    ranked = scores.filter(near).withColumn("_place", F.row_number().over(by_id)).join(placed, "score")
    rank = (F.col("_above") + F.col("_place")).cast("long")
    ranked = ranked.withColumn("rank", F.when(rank <= size, rank)).drop("_place", "_above")
    return ranked.unionByName(scores.filter(~near).withColumn("rank", none))


def importance_resampling(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    scale: int = 1000,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_features, weight, score, rank``.

    Features are all runs of 1 to ``longest`` words, repeats counted. ``weight`` is the floored mean of their buckets'
    gains (0 without features), ``score`` adds noise that depends on the id only, and ``rank`` numbers the drawn
    documents by falling score, ties by smaller id, a null id last. A null or empty text has no features and is
    never drawn; a null id takes the noise of an empty one; rows of one id are documents of their own and have
    the same noise. A very long text is one row of bucket numbers. Empty tables on either side count as zero features.
    Other columns, and any columns of ``target`` but ``text``, are ignored.
    """
    raw = saved(hashed(docs, ["doc_id"], longest, buckets), "features")
    wanted = hashed(target, [], longest, buckets)
    gains = bucket_gains(raw, wanted, buckets, scale)
    scored = mean_gains(raw, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed, scale))
    scores = saved(scored, "scores")
    return drawn(scores, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
