"""Packing by concatenation: all documents' tokens as one stream, cut into windows of equal length.

Pass one tokenizes: each row gets its ids and the number of tokens before it in its block of the input. The totals of
the blocks give each one's place in the stream (prefix sums). Pass two cuts each document at the multiples of the window
length; a piece at a boundary says so.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakestream.llm.common import saved
from lakestream.llm.pieces import cutter

#: Pre-tokens whose ids a task remembers.
REMEMBERED = 400_000
#: A block of rows that one task reads in order.
RUN = ("file", "origin", "block")
#: Blocks whose places are broadcast: 32 MB of numbers. Beyond, the ids are shuffled to them.
BROADCAST_BLOCKS = 1_000_000


class Ids(dict):
    """Pre-token to the bytes of its ids (little-endian, 32 bits each), tokenized when first met.

    The first ``REMEMBERED`` ones stay, which has all the frequent ones of the texts a task begins with; others are
    tokenized once per slice of texts, so a task that goes on to another language is slower there, not wrong.
    """

    def __init__(self, path: str):
        self.cutter = cutter(path)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        parts = self.bytes_of(texts)
        return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4

    def bytes_of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        pieces = [self.cutter.cut(t) for t in texts]
        new = list(set().union(*pieces).difference(self))
        ids = map(self.cutter.ids, new)
        self.update(zip(new, [struct.pack(f"<{len(i)}I", *i) for i in ids], strict=True))
        out = [b"".join(map(self.__getitem__, ps)) for ps in pieces]
        for piece in new[max(0, len(new) - max(0, len(self) - REMEMBERED)) :]:
            del self[piece]
        return out


@lru_cache(1)
def remembered(path: str) -> Ids:
    """One per worker process, so that tasks go on with what earlier ones met."""
    return Ids(path)


def written_order(docs: DataFrame) -> list[Column]:
    """Where a row stands among those that Spark wrote as files: ``file`` by number, ``origin``, ``block``.

    A scan deals out blocks of files by size, so the order of its partitions is not that of the rows as they were
    written. ``origin`` tells files of one number apart. Rows that come from no files stand by partition.
    """
    try:
        docs.select("_metadata.file_block_start")
    except AnalysisException:
        zero = F.lit(0).cast("long")
        return [F.spark_partition_id().cast("long").alias("file"), zero.alias("origin"), zero.alias("block")]
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long")
    return [
        F.coalesce(number, F.lit(0).cast("long")).alias("file"),
        F.xxhash64("_metadata.file_path").alias("origin"),
        F.col("_metadata.file_block_start").alias("block"),
    ]


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``file, origin, block, before, doc_id, n, ids``: a document's ids with ``end_id`` after them.

    ``before`` are the tokens before it in its block, which one task reads from its first row to its last.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, end, last, done = remembered(path), np.array([end_id], "<u4").tobytes(), None, 0
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.iloc[start : start + 500]
                ids = [data + end for data in known.bytes_of([t or "" for t in part["text"]])]
                sizes, befores = [len(data) // 4 for data in ids], []
                for place, size in zip(zip(part["origin"], part["file"], part["block"], strict=True), sizes, strict=True):
                    done = done if place == last else 0
                    befores.append(done)
                    last, done = place, done + size
                yield part[[*RUN, "doc_id"]].assign(before=befores, n=sizes, ids=ids)

    rows = docs.select(*written_order(docs), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(stream, "file long, origin long, block long, doc_id string, before long, n long, ids binary")


def run_bases(rows: DataFrame) -> DataFrame:
    """``file, origin, block, base``: the tokens of all blocks before each.

    Files are counted in shelves of 1,024, so a window holds one shelf's blocks, or one row per shelf.
    """
    totals = rows.groupBy(*RUN).agg(F.sum("n").alias("total")).withColumn("shelf", F.floor(F.col("file") / 1024))
    totals = saved(totals, "block-tokens")
    earlier = (Window.unboundedPreceding, -1)
    so_far = lambda value, window: F.coalesce(F.sum(value).over(window.rowsBetween(*earlier)), F.lit(0).cast("long"))
    shelves = totals.groupBy("shelf").agg(F.sum("total").alias("sum"))
    shelves = shelves.select("shelf", so_far("sum", Window.orderBy("shelf")).alias("below"))
    inside = so_far("total", Window.partitionBy("shelf").orderBy(*RUN))
    bases = totals.withColumn("inside", inside).join(shelves, "shelf")
    bases = bases.select(*RUN, (F.col("below") + F.col("inside")).alias("base"))
    # four numbers per block of the input: sent to all tasks while they are few, so that no ids are shuffled
    return F.broadcast(bases) if totals.count() <= BROADCAST_BLOCKS else bases


def packed(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, boundary``.

    A document is its ids followed by ``end_id``; a null or empty text is that id alone. Documents follow each other
    as they stand in the files they are read from, by the numbers of the files, else in the order of their partitions and
    rows; every ``window`` tokens are a sequence, so only the last one is short. ``boundary`` tells whether a piece
    ``begins``, ``ends`` or ``crosses`` its document at a cut (``whole`` if it is the document). Null ids and repeated
    rows are documents of their own. An empty table gives no rows. Other columns are ignored.
    """
    rows = saved(tokenized(docs, path, end_id), "token-ids")
    placed = rows.join(run_bases(rows), list(RUN))
    placed = placed.select("doc_id", (F.col("base") + F.col("before")).alias("at"), "ids")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, at, ids in zip(batch["doc_id"], batch["at"], batch["ids"], strict=True):
                n, first = len(ids) // 4, int(at)
                cuts = [0, *range(window - first % window, n, window), n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    where = ("whole" if b == n else "begins") if a == 0 else ("ends" if b == n else "crosses")
                    out.append((doc_id, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n, (first + a) // window, (first + a) % window, where))
            yield pd.DataFrame(out, columns=COLUMNS)

    return placed.mapInPandas(cut, SCHEMA).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"]
SCHEMA = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary string"
