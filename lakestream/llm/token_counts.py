"""Token counts without token ids: distinct pre-tokens are counted once and joined to their frequencies.

A block is a run of a task's documents. It keeps its pre-tokens as a dictionary and each document's pre-token
frequencies as indexes into it, so the frequency table is a few bytes per entry. The dictionaries alone are
shuffled: all blocks' entries meet by pre-token, each distinct pre-token is tokenized once, and its length goes back
with the entries to their block, where frequencies times lengths are summed. A pre-token that is in every text has
one entry per block, not per document.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestream.llm.common import saved
from lakestream.llm.pieces import cutter

#: Characters of a block.
BLOCK = 32_000_000
#: A pre-token has fewer tokens than this.
WIDE = 1 << 31
BLOCKS = (
    "block long, doc_ids array<string>, n_bytes array<long>, pieces array<string>,"
    " sizes array<int>, entries binary, times binary"
)


class Block:
    """Documents gathered with their dictionary and frequencies.

    ``sizes`` are the distinct pre-tokens per document; ``entries`` are their indexes, rising within a document and
    written as differences, and ``times`` how often each occurs. Both are compressed 32-bit numbers.
    """

    def __init__(self):
        self.names: defaultdict[str, int] = defaultdict()
        self.names.default_factory = self.names.__len__
        self.doc_ids, self.n_bytes, self.entries, self.times, self.chars = [], [], [], [], 0

    def add(self, doc_id: str | None, text: str, pieces: list[str]) -> None:
        counts = Counter(pieces)
        entries = np.fromiter(map(self.names.__getitem__, counts), np.int32, len(counts))
        times = np.fromiter(counts.values(), np.int32, len(counts))
        order = np.argsort(entries)
        self.doc_ids.append(doc_id)
        self.n_bytes.append(len(text.encode()))
        self.entries.append(np.diff(entries[order], prepend=np.int32(0)))
        self.times.append(times[order])
        self.chars += len(text)

    def row(self, number: int) -> pd.DataFrame:
        pack = lambda arrays: zlib.compress(np.concatenate(arrays).astype("<i4").tobytes(), 1)
        return pd.DataFrame(
            {
                "block": [number],
                "doc_ids": [self.doc_ids],
                "n_bytes": [self.n_bytes],
                "pieces": [list(self.names)],
                "sizes": [np.array([len(e) for e in self.entries], np.int32)],
                "entries": [pack(self.entries)],
                "times": [pack(self.times)],
            }
        )


def document_totals(sizes: np.ndarray, entries: bytes, times: bytes, lengths: np.ndarray) -> np.ndarray:
    """Sum of frequency times length per document of a block."""
    steps, counts = (np.frombuffer(zlib.decompress(b), "<i4").astype(np.int64) for b in (entries, times))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    run = np.concatenate([[0], np.cumsum(steps)])
    index = run[1:] - np.repeat(run[ends[:-1]], sizes)  # differences start anew with each document
    sums = np.concatenate([[0], np.cumsum(lengths[index] * counts)])
    return np.diff(sums[ends])


def frequency_blocks(docs: DataFrame, path: str) -> DataFrame:
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = cutter(path).cut
        block, number = Block(), 0
        for batch in batches:
            if number == 0:
                number = int(batch["part"].iloc[0]) << 32 if len(batch) else 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                block.add(doc_id, text or "", cut(text or ""))
                if block.chars >= BLOCK:
                    yield block.row(number)
                    block, number = Block(), number + 1
        if block.doc_ids:
            yield block.row(number)

    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(blocks, BLOCKS)


def piece_lengths(entries: DataFrame, path: str) -> DataFrame:
    """``block, sized``: entries with the number of tokens of their ``piece``, as ``entry * WIDE + n``.

    Entries are brought together and sorted by pre-token, so each is tokenized once, when it first comes by.
    """

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = cutter(path).tokens
        last, size = None, 0
        for batch in batches:
            codes, distinct = pd.factorize(batch["piece"])
            new = list(distinct)
            known = bool(new) and new[0] == last
            n = tokens(new[known:])[1]
            n = np.concatenate([[size], n]) if known else n
            if new:
                last, size = new[-1], n[-1]
            sized = batch["entry"].to_numpy(np.int64) * WIDE + n[codes]
            yield pd.DataFrame({"block": batch["block"], "sized": sized})

    together = entries.repartition("piece").sortWithinPartitions("piece")
    return together.mapInPandas(lengths, "block long, sized long")


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the tokenizer file at ``path`` over the whole text, with no special tokens added and special
    strings in a text taken as such. Null counts as an empty text, of 0 bytes and 0 tokens. Null ids and repeated
    rows are rows of their own. An empty table gives no rows. Other columns are ignored.
    """
    blocks = saved(frequency_blocks(docs, path), "frequencies")
    entries = blocks.select("block", F.posexplode("pieces").alias("entry", "piece"))
    sized = piece_lengths(entries, path).groupBy("block").agg(F.collect_list("sized").alias("sized"))
    joined = blocks.drop("pieces").join(sized, "block", "left")

    @F.pandas_udf("array<bigint>")
    def summed(sizes: pd.Series, entries: pd.Series, times: pd.Series, sized: pd.Series) -> pd.Series:
        out = []
        for s, e, t, found in zip(sizes, entries, times, sized, strict=True):
            found = np.zeros(0, np.int64) if found is None else np.asarray(found)
            lengths = np.zeros(len(found), np.int64)
            lengths[found // WIDE] = found % WIDE
            out.append(document_totals(s, e, t, lengths))
        return pd.Series(out, dtype=object)

    totals = joined.withColumn("n_tokens", summed("sizes", "entries", "times", "sized"))
    rows = totals.select(F.explode(F.arrays_zip("doc_ids", "n_bytes", "n_tokens")).alias("d")).select("d.*")
    doc_id = F.col("doc_ids").cast(docs.schema["doc_id"].dataType)
    return rows.select(doc_id.alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
