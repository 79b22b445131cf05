"""Jaccard join on word n-grams by MinHash banding, verified on the full n-gram sets.

1. Each text gets a key (its words), and one hash per band. Texts with the same words are one node from here on.
2. Nodes meet in buckets, one per band and band hash. Buckets of one node go; of buckets with the same members,
   one stays. All that is counts and sums, no list of members.
3. The nodes left in buckets get their n-gram sets. A bucket is cut into blocks of nodes, and every pair of blocks
   is a tile: one task compares its sets as a matrix product. A pair that shares several buckets counts in the
   smallest of them only. A tile returns a link count per node and a spanning forest of its links, never pairs, so
   a large group of near copies leaves as many rows as it has members.
4. Connected components of the forests are the classes.

Band and row counts follow from the wanted recall at the threshold: 20 bands of 5 rows find a pair of similarity 0.8
with probability 0.9996, and a closer one more surely. Every pair found is verified exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestream.llm.common import SPACE, WORD, filled, saved, slices, whole_row
from lakestream.llm.components import components

WORDS = re.compile(WORD)
#: Characters hashed at once, and nodes of a block: a tile compares two blocks.
SLICE, BLOCK = 2_000_000, 512
MIX = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """Bands and rows per band that find a pair at the threshold with the wanted recall.

    Of the choices within the hash budget, the one with the most rows: it lets the fewest dissimilar pairs through.
    """
    fits = []
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes:
            fits.append((rows, bands))
    rows, bands = max(fits)
    return bands, rows


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word n-grams of the texts, and where each text's begin (one more than texts).

    A text of fewer words has one gram, all its words; a text without words has none. Grams repeat.
    """
    words = [WORDS.findall(t or "") for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = pd.Series([x for w in words for x in w], dtype=object)
    hashed = pd.util.hash_array(flat.to_numpy(), categorize=True) if len(flat) else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(len(hashed), np.uint64)
    owner = np.repeat(np.arange(len(words)), counts)
    left = np.repeat(starts[1:], counts) - np.arange(len(hashed))  # words from here to the text's end
    for i in range(n):
        reach = left > i
        rolled[reach] = scramble(rolled[reach] * MIX + hashed[np.flatnonzero(reach) + i] + np.uint64(i + 1))
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    inside = np.arange(len(hashed)) - starts[owner] < size[owner]
    return rolled[inside], np.concatenate([[0], np.cumsum(size)])


def band_hashes(values: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per text and band, from the minima of ``rows`` hash functions; zeros for a text without grams."""
    out = np.zeros((len(at) - 1, bands), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    starts = at[some]
    salts = scramble(np.arange(1, bands * rows + 1, dtype=np.uint64) * MIX) | np.uint64(1)
    for band in range(bands):
        mixed = np.full(len(some), band + 1, np.uint64)
        for salt in salts[band * rows : (band + 1) * rows]:
            order = (values ^ salt) * salt
            order ^= order >> np.uint64(32)
            order *= MIX
            mixed = scramble(mixed * MIX + np.minimum.reduceat(order, starts))
        out[some, band] = mixed
    return out


def text_key(text: Column) -> Column:
    """Texts with the same words in the same order have the same key."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(filled(text), SPACE, " ")), 256))


def with_bands(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, key, bands``: the band hashes as an array, empty for a text without words."""

    @F.pandas_udf("array<bigint>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts, out = texts.tolist(), []
            for start, stop in slices([len(t or "") for t in texts], SLICE):
                values, at = grams(texts[start:stop], n)
                signed = band_hashes(values, at, bands, rows).view(np.int64)
                out += [row if size else row[:0] for row, size in zip(signed, np.diff(at), strict=True)]
            yield pd.Series(out, dtype=object)

    return docs.select("doc_id", text_key(F.col("text")).alias("key"), hashed("text").alias("bands"))


def kept_buckets(members: DataFrame) -> DataFrame:
    """``bucket, n`` of buckets ``(bucket, node)`` with several nodes, one of each set of equal buckets."""
    sums = members.groupBy("bucket").agg(
        F.count("*").alias("n"),
        F.min("node").alias("least"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.col("node"), F.lit(1))).alias("y"),
    )
    return sums.filter("n > 1").groupBy("n", "least", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")


def gram_set(texts: list[str | None], n: int) -> list[bytes]:
    values, at = grams(texts, n)
    return [np.unique(values[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each two of the sets share: a product of 0/1 matrices, taken in column blocks."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[column] > 1
    owner, column = owner[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((n, n), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, last, width):
        a, b = np.searchsorted(column, [start, start + width])
        block = np.zeros((n, min(width, last - start)), np.float32)
        block[owner[a:b], column[a:b] - start] = 1
        total += block @ block.T
    return total


def earlier_band(bands: np.ndarray, at: int) -> np.ndarray:
    """For each two nodes, whether they share a bucket of a band before ``at``; 0 is no bucket."""
    met = np.zeros((len(bands), len(bands)), bool)
    for band in bands[:, :at].T:
        met |= (band[:, None] == band[None, :]) & (band != 0)[:, None]
    return met


def binary_views(column: pa.ChunkedArray) -> pd.Series:
    """The values of a binary column as views of its memory, which is not copied."""
    out = []
    for chunk in column.chunks:
        kind = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, kind, len(chunk) + 1 + chunk.offset)[chunk.offset :].tolist()
        data = memoryview(data or b"")
        out += [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return pd.Series(out, dtype=object)


def arrow_tile_links(tile: pa.Table, threshold: float) -> pa.Table:
    rows = tile.drop_columns(["grams"]).to_pandas()
    found = tile_links(rows.assign(grams=binary_views(tile.column("grams"))), threshold)
    # a worker lives on: what the tile took goes back at once
    pa.default_memory_pool().release_unused()
    return pa.Table.from_pandas(found, preserve_index=False)


def tile_links(tile: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of one tile: ``node, links, root`` of nodes with links; ``root`` spans what the tile connects.

    ``links`` adds up the copies of a node's partners. In a tile of two blocks only pairs across them count, and
    a pair that met in an earlier band's bucket was counted there.
    """
    tile = tile.drop_duplicates("node")
    bands = np.stack(tile["buckets"].to_numpy())
    here = int(np.flatnonzero((bands == tile["bucket"].iloc[0]).all(axis=0))[0])
    fresh = ~earlier_band(bands, here)
    if tile["first"].iloc[0] != tile["second"].iloc[0]:
        block = tile["block"].to_numpy()
        fresh &= block[:, None] != block[None, :]
    np.fill_diagonal(fresh, False)
    some = np.flatnonzero(fresh.any(axis=1))
    if not len(some):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("node", "links", "root")})
    fresh = fresh[np.ix_(some, some)]
    nodes, copies = (tile[c].to_numpy()[some] for c in ("node", "copies"))
    sets = [np.frombuffer(g, np.uint64) for g in tile["grams"].iloc[some]]
    size = np.array([len(s) for s in sets], np.float64)
    shared = overlaps(sets).astype(np.float64)
    close = fresh & (shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9)
    a, b = np.nonzero(np.triu(close))
    links = close @ copies
    root = np.arange(len(nodes))
    while len(a):  # least root over the links until nothing changes
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    has = links > 0
    return pd.DataFrame({"node": nodes[has], "links": links[has].astype(np.int64), "root": nodes[root[has]]})


def near_links(
    docs: DataFrame, n: int, threshold: float, recall: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``doc_id, key, row_id``; distinct texts ``key, node, copies, least``; their ``node, links, root`` by tile."""
    bands, rows = banding(threshold, recall)
    keyed = with_bands(docs, n, bands, rows).withColumn("row_id", F.monotonically_increasing_id())
    keyed = saved(keyed, "bands")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("least")
    nodes = saved(keyed.groupBy("key").agg(least, F.count("*").alias("copies")).select(
        "key", F.col("least.row_id").alias("node"), "copies", F.col("least.doc_id").alias("least")
    ), "nodes")
    members = keyed.join(nodes.select("node"), F.col("row_id") == F.col("node"), "left_semi")
    members = members.select(F.col("row_id").alias("node"), F.posexplode("bands").alias("band", "bucket"))
    members = saved(members, "members")
    kept = members.join(kept_buckets(members), "bucket")
    kept = saved(kept, "buckets")
    by_band = F.map_from_entries(F.collect_list(F.struct("band", "bucket")))
    mine = kept.groupBy("node").agg(by_band.alias("_map")).select(
        "node", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.coalesce(F.col("_map")[i], F.lit(0))).alias("buckets")
    )

    @F.pandas_udf("binary")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts, out = texts.tolist(), []
            for start, stop in slices([len(t or "") for t in texts], SLICE):
                out += gram_set(texts[start:stop], n)
            yield pd.Series(out, dtype=object)

    wanted = nodes.join(mine, "node").select(F.struct(F.col("least"), "key").alias("_at"), "node", "copies", "buckets")
    texts = docs.select(F.struct(F.col("doc_id").alias("least"), text_key(F.col("text")).alias("key")).alias("_at"), "text")
    chosen = texts.join(wanted, "_at").select("node", "copies", "buckets", sets("text").alias("grams"))
    # a node once per tile: blocks of a bucket are dealt by hash, and each block meets itself and every other
    at = kept.select(F.col("node").alias("_node"), "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    at = at.withColumn("block", F.pmod(F.xxhash64("_node"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = chosen.join(at, F.col("node") == F.col("_node")).select(
        "bucket",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
        "block",
        "node",
        "copies",
        "buckets",
        "grams",
    )
    compared = tiles.groupBy("bucket", "first", "second").applyInArrow(
        lambda tile: arrow_tile_links(tile, threshold), "node long, links long, root long"
    )
    return keyed.select("doc_id", "key", "row_id"), nodes, saved(compared, "links")


def near_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row per document: ``doc_id, key, class_id, n_links, class_size, kept``.

    Two documents are linked if their sets of word ``n``-grams have a Jaccard similarity of at least
    ``threshold``; ``n_links`` counts the linked documents, copies too. ``class_id`` is the smallest ``doc_id``
    that links lead to. One row per class is ``kept``: one with that id, also where ids are null or repeated. A text of fewer than ``n``
    words has one gram, all its words. A text without words (null, empty) has no gram and no links; such documents
    share a key but each is a class of its own. Repeated rows are copies, of which one is kept. An empty table gives
    no rows. Other columns are ignored.
    """
    return classified(*near_links(docs, n, threshold, recall))


def classified(keyed: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes and link counts of distinct texts, brought back to all rows ``doc_id, key, row_id``."""
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = nodes.join(counts, "node", "left").join(roots, "node", "left")
    found = found.withColumn("root", F.coalesce("root", "node"))
    found = saved(found, "linked-nodes")
    # a node is the row with its text's smallest id
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    classes = found.groupBy("root").agg(first.alias("first"), F.sum("copies").alias("class_size"))
    classes = classes.select("root", F.col("first.least").alias("class_id"), F.col("first.node").alias("winner"), "class_size")
    texts = found.join(classes, "root").select(
        "key", "class_id", "winner", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    empty = F.unhex(F.sha2(F.lit(""), 256))
    rows = keyed.join(texts, "key")
    bare = F.col("key") == empty
    return rows.select(
        "doc_id",
        "key",
        F.when(bare, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(bare, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(bare, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (bare | (F.col("row_id") == F.col("winner"))).alias("kept"),
    )


def one_per_class(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """The documents that stay, one per class, with the columns of ``docs``; repeated rows of one stay once.

    Texts without words all stay: they are near nothing.
    """
    kept = near_classes(docs, n, threshold, recall).filter("kept").select(F.struct("doc_id", "key").alias("_at"))
    bare = text_key(F.col("text")) == F.unhex(F.sha2(F.lit(""), 256))
    rows = docs.select(F.struct("doc_id", text_key(F.col("text")).alias("key")).alias("_at"), whole_row(docs), bare.alias("_bare"))
    one = rows.filter(~F.col("_bare")).join(kept, "_at", "left_semi").dropDuplicates(["_at"])
    return one.unionByName(rows.filter("_bare")).select("_row.*")
