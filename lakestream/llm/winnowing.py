"""Benchmark decontamination by winnowing.

A text's fingerprints are k-grams of words: of every window of consecutive k-gram hashes the smallest stays (of equal
ones the last). Two texts that share ``span`` words share such a window, hence its fingerprint, if the window has
``span - k + 1`` hashes; so no shared span of that length is missed. Document fingerprints are joined to those of the
benchmark, and each match is extended to both sides over the words themselves, which also undoes hash collisions.

A match must be extended by ``span - k`` words only, since longer shared runs hold further fingerprints; those words
travel with a fingerprint, and documents are read once. Before the join a bit table of the benchmark's hashes,
of one fixed size, drops nearly all document fingerprints inside the task that makes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestream.llm.common import saved
from lakestream.llm.words import Words, word_slices

#: Words of a k-gram; shorter spans are one k-gram.
GRAM = 5
#: Bits of the table of benchmark hashes (2 MB), whatever the benchmark's size.
TABLE_BITS = 24
#: Odd multipliers of the rolling hashes, any will do.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

PRINTS = "at long, hash long, gram string, before array<string>, after array<string>"


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, so that the smallest of some is a random one."""
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the byte base and of its inverse modulo 2**64, as many as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            both = ((BYTE_BASE, "up"), (pow(BYTE_BASE, -1, 1 << 64), "down"))
            for base, name in both:
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def word_hashes(found: Words) -> np.ndarray:
    """A 64-bit hash per word: the difference of two running sums, moved to the place of the first byte."""
    up, down = POWERS.of(len(found.data) + 1)
    sums = np.zeros(len(found.data) + 1, np.uint64)
    np.cumsum((found.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[found.ends] - sums[found.starts]) * down[found.starts])


def fingerprints(hashes: np.ndarray, row: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a fingerprint's k-gram begins, rising, and its hash; k-grams and windows lie within a row."""
    k = min(GRAM, span)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.full(len(hashes) - k + 1, np.uint64(span))
    for j in range(k):
        grams = grams * np.uint64(WORD_BASE) + hashes[j : j + len(grams)]
    grams = mixed(grams)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, span - k + 1):
        later = grams[j : j + n]
        take = later <= least
        np.copyto(least, later, where=take)
        at[take] = np.flatnonzero(take) + j
    at = at[row[:n] == row[span - 1 :]]
    at = at[np.diff(at, prepend=-1) > 0]
    return at, grams[at]


def prints(docs: DataFrame, ids: list[str], spans: list[int], table: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """``ids``, ``n_words`` and per span ``prints_<span>``: fingerprints with the words around their k-gram.

    The words before stand nearest first. With a ``table`` (numbers and contents of its 64-bit words) only fingerprints
    whose bit is set stay. Without one, a row has fingerprints of the span that fits its length only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << TABLE_BITS - 6, np.uint64)
        if table is not None:
            bits[table[0]] = table[1]
        kind = pa.list_(pa.struct([("at", pa.int64()), ("hash", pa.int64()), ("gram", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))
        for batch in batches:
            for first, last, found in word_slices(batch.column("_text")):
                hashes = word_hashes(found)
                begin = np.cumsum(found.counts) - found.counts
                columns = []
                for span in spans:
                    at, h = fingerprints(hashes, found.row, span)
                    if table is None:
                        fits = np.minimum(found.counts[found.row[at]], max(spans)) == span
                    else:
                        bit = h & np.uint64((1 << TABLE_BITS) - 1)
                        fits = (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                    k, reach = min(GRAM, span), span - min(GRAM, span)
                    out = [[] for _ in range(last - first)]
                    for i, value in zip(at[fits].tolist(), h[fits].view(np.int64).tolist(), strict=True):
                        r = int(found.row[i])
                        low, high = int(begin[r]), int(begin[r] + found.counts[r])
                        out[r].append(
                            {
                                "at": i - low,
                                "hash": value,
                                "gram": " ".join(map(found.text, range(i, i + k))),
                                "before": list(map(found.text, range(i - 1, max(low, i - reach) - 1, -1))),
                                "after": list(map(found.text, range(i + k, min(high, i + k + reach)))),
                            }
                        )
                    columns.append(pa.array(out, kind))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(first, last - first) for c in ids], pa.array(found.counts, pa.int64()), *columns],
                    names=[*ids, "n_words", *[f"prints_{s}" for s in spans]],
                )

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids]
    lists = [f"prints_{s} array<struct<{', '.join(':'.join(p.split(' ')) for p in PRINTS.split(', '))}>>" for s in spans]
    return docs.select(*ids, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*kinds, "n_words long", *lists]))


def flat(rows: DataFrame, ids: list[str], spans: list[int]) -> DataFrame:
    """One row per fingerprint, with its ``span``."""
    each = [rows.select(*ids, F.lit(s).alias("span"), F.inline(f"prints_{s}")) for s in spans]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def bit_table(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The table's words that hold a bit of a hash: at most 2**18 rows."""
    bit = F.col("hash").bitwiseAND((1 << TABLE_BITS) - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    words = items.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toPandas()
    return words["at"].to_numpy(np.int64), words["bits"].to_numpy(np.int64).view(np.uint64)


def shared(left: Column, right: Column) -> Column:
    """How many first elements two arrays have in common."""
    same = F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies in an occurrence of ``span`` consecutive words of an item, or of all words of an item that
    has fewer. ``n_items`` counts the items with such a window here, and ``items_sha256`` is the digest of their ids
    as sorted strings. Rows of the benchmark with one id are one item; its null id is an item with an empty
    name. A null or empty text has no words and no hits, an item without words none either. Repeated rows and null
    ids of documents are documents of their own. Empty tables give no rows, or no hits. Other columns are ignored.
    """
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    items = saved(prints(named, ["item"], list(range(1, span + 1)), None), "benchmark-prints")
    # which of the (at most ten) lengths there are
    fits = items.filter("n_words > 0").select(F.least("n_words", F.lit(span)).alias("s")).distinct().collect()
    spans = sorted(r["s"] for r in fits) or [span]
    # equal surroundings are looked at once, however many items have them
    place = ["span", "hash", "gram", "before", "after"]
    around = flat(items, ["item"], spans).select("item", *place)
    around = saved(around.withColumn("context", F.sha2(F.to_json(F.struct(*place)), 256)), "benchmark-contexts")
    contexts = around.dropDuplicates(["context"]).select("context", *place)

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id"))
    found = saved(prints(rows, ["row_id", "doc_id"], spans, bit_table(contexts)), "document-prints")
    ours = flat(found, ["row_id"], spans)
    theirs = contexts.select("context", "span", "hash", "gram", F.col("before").alias("_before"), F.col("after").alias("_after"))
    met = ours.join(theirs, ["hash", "span", "gram"])
    met = met.withColumns({"_left": shared(F.col("before"), F.col("_before")), "_right": shared(F.col("after"), F.col("_after"))})
    size = F.least(F.col("span"), F.lit(GRAM)) + F.col("_left") + F.col("_right")
    first = F.col("at") - F.col("_left")
    hits = met.filter(size >= F.col("span")).select("row_id", "context", first.alias("first"), (first + size - 1).alias("last"))
    hits = saved(hits, "benchmark-hits")

    words = hits.select("row_id", "first", "last").distinct().select("row_id", F.explode(F.sequence("first", "last")).alias("word"))
    n_hit = words.distinct().groupBy("row_id").agg(F.count("*").alias("n_hit"))
    pairs = hits.select("row_id", "context").distinct().join(around.select("context", "item").distinct(), "context")
    pairs = pairs.select("row_id", "item").distinct().groupBy("row_id")
    named = pairs.agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("names"))
    zero = F.lit(0).cast("long")
    return (
        found.select("row_id", "doc_id", "n_words")
        .join(n_hit.join(named, "row_id"), "row_id", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", zero).alias("n_hit"),
            F.coalesce("n_items", zero).alias("n_items"),
            F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )
