"""Connected components by alternating stars, with every hop a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestream.llm.common import saved


def star(edges: DataFrame) -> DataFrame:
    """Point each node's larger neighbours, and then each node's smaller ones, at its smallest neighbour.

    ``edges`` are distinct ``(a, b)`` with ``a < b``. The smallest neighbour is a partial aggregate, written out and
    joined back: with a shuffle of its own on either side, adaptive execution splits the join at a node that has
    very many neighbours.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    least = saved(least, "least")
    large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b")
    large = saved(large.filter("a < b").distinct(), "large-star")
    down = saved(large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n"), "least-below")
    small = large.join(down, F.col("b") == F.col("n"))
    to_least = small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return saved(to_least.filter("a < b").distinct(), "small-star")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of undirected ``(a, b)`` edges; the root is the smallest node reached.

    Rounds go on until the edges stay as they are; their number grows with the logarithm of the longest chain.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges, state = saved(ordered, "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark[0] == 0 or mark == state:
            break
        edges, state = star(edges), mark
    roots = edges.select(F.col("a").alias("node")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        roots.withColumn("root", F.col("node"))
    )
