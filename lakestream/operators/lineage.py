"""Lineage from run events ``(run_id, event_time, event_type, job, inputs, outputs)``."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.operators.latest import latest_per_key
from lakestream.operators.sampling import weighted_sample
from lakestream.session import work_dir

#: Folders that edges are dealt into by node.
BUCKETS = 16


def lineage_edges(events: DataFrame) -> DataFrame:
    """Edges dataset -> job (``reads``) and job -> dataset (``writes``) of each job's latest completed run.

    Datasets are linked through the job, never input by output, so a wide job adds inputs plus outputs edges.
    """
    runs = latest_per_key(events.filter("event_type = 'COMPLETE'"), ["job"], ["event_time", "run_id"])
    reads = runs.select(F.explode("inputs").alias("source"), F.col("job").alias("target"), F.lit("reads").alias("kind"))
    writes = runs.select(F.col("job").alias("source"), F.explode("outputs").alias("target"), F.lit("writes").alias("kind"))
    return reads.unionByName(writes).distinct()


def _bucket(node: str = "node") -> Column:
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int").alias("bucket")


def _buckets_of(frontier: DataFrame) -> list[int]:
    """Buckets that a frontier has nodes in, of ``BUCKETS`` numbers at most; none once it is empty."""
    return [r["bucket"] for r in frontier.select("bucket").distinct().collect()]


def _stored_edges(spark: SparkSession, edges: DataFrame, base: str, direction: str) -> list[DataFrame]:
    """Edges out of datasets and out of jobs as ``node, next, bucket``, in a folder per bucket of nodes."""
    if direction not in ("downstream", "upstream"):
        raise ValueError(f"unknown direction: {direction}")
    ends = ("source", "target") if direction == "downstream" else ("target", "source")
    # a step from a dataset, then one from a job
    kinds = ("reads", "writes") if direction == "downstream" else ("writes", "reads")
    stored = edges.select(F.col(ends[0]).alias("node"), F.col(ends[1]).alias("next"), "kind", _bucket(ends[0]))
    stored.hint("rebalance", "kind", "bucket").write.partitionBy("kind", "bucket").parquet(f"{base}/edges")
    whole = spark.read.schema("node string, next string, kind string, bucket int").parquet(f"{base}/edges")
    return [whole.filter(F.col("kind") == kind).drop("kind") for kind in kinds]


def lineage_closure(
    spark: SparkSession, edges: DataFrame, start: str, direction: str = "downstream"
) -> DataFrame:
    """Datasets reachable from ``start`` with their distance in jobs; cycles are fine.

    Breadth-first, a step from datasets to jobs or back at a time, until a step finds nothing new. Edges and frontiers
    are tables in the shared folder, so plans stay short and survive the loss of an executor. A step reads the
    edges of its frontier's buckets only, and the measured size of the frontier decides whether it is broadcast or
    those edges are shuffled.
    """
    base = work_dir(spark, "closure")
    leave = _stored_edges(spark, edges, base, direction)

    def read(steps: Sequence[int]) -> DataFrame:
        paths = [f"{base}/reached/step={i}" for i in steps]
        return spark.read.schema("node string, bucket int, step int").option("basePath", f"{base}/reached").parquet(*paths)

    spark.range(1).select(F.lit(start).alias("node")).select("node", _bucket()).write.parquet(f"{base}/reached/step=0")
    done = [0]
    for step in itertools.count(1):
        buckets = _buckets_of(read([step - 1]))
        if not buckets:
            break
        near = leave[(step - 1) % 2].filter(F.col("bucket").isin(buckets))
        reached = near.join(read([step - 1]).select("node"), "node").select(F.col("next").alias("node")).distinct()
        # datasets come up in even steps, jobs in odd ones
        earlier = [i for i in done if i % 2 == step % 2]
        found = reached.join(read(earlier).select("node"), "node", "left_anti") if earlier else reached
        found.select("node", _bucket()).write.parquet(f"{base}/reached/step={step}")
        done.append(step)
    found = read([i for i in done if i % 2 == 0]).filter("step > 0")
    return found.select(F.col("node").alias("dataset"), F.floor(F.col("step") / 2).cast("int").alias("distance"))


def _spread(spark: SparkSession, base: str, leave: Sequence[DataFrame], first: DataFrame) -> DataFrame:
    """Bits of words carried from dataset to dataset until none gets a new one; all that came to datasets, by ``step``.

    Rows of ``first`` are ``node, back, word, bits, skip``: one set of edges for rows with ``back``, another for those
    without. A row stops before datasets whose ``covered`` has a bit of its ``skip``. A step goes through the jobs, merges
    by bitwise or at them and at the datasets, and keeps the bits that a dataset did not have before.
    """
    rows = "node string, back boolean, word long, bits long, skip long, bucket int, step int"

    def read(steps: Sequence[int]) -> DataFrame:
        paths = [f"{base}/step={i}" for i in steps]
        return spark.read.schema(rows).option("basePath", base).parquet(*paths)

    def move(here: DataFrame, near: DataFrame) -> DataFrame:
        there = here.select("node", "back", "word", "bits", "skip").join(near.drop("bucket"), ["node", "back"])
        there = there.filter(F.col("covered").bitwiseAND(F.col("skip")) == 0)
        return there.select(F.col("next").alias("node"), "back", "word", "bits", "skip")

    def merge(rows: DataFrame, *bits: str) -> DataFrame:
        return rows.groupBy("node", "back", "word").agg(*[F.bit_or(c).alias(c) for c in bits], F.first("skip").alias("skip"))

    none = F.lit(0).cast("long")
    first.select("*", _bucket()).write.parquet(f"{base}/step=0")
    for step in itertools.count(1):
        buckets = _buckets_of(read([step - 1]))
        if not buckets:
            return read(range(step))
        jobs = merge(move(read([step - 1]), leave[0].filter(F.col("bucket").isin(buckets))), "bits")
        known = read(range(step)).select("node", "back", "word", none.alias("bits"), "skip", F.col("bits").alias("known"))
        here = merge(move(jobs, leave[1]).withColumn("known", none).unionByName(known), "bits", "known")
        fresh = F.col("bits").bitwiseAND(F.bitwise_not("known"))
        here = here.select("node", "back", "word", fresh.alias("bits"), "skip").filter("bits != 0")
        here.select("*", _bucket()).write.parquet(f"{base}/step={step}")


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("int"))


def _landmarks(spark: SparkSession, leave: Sequence[DataFrame], base: str) -> DataFrame:
    """``node, back, bits``: of up to 64 datasets, those that reach a dataset and, with ``back``, those that it reaches.

    They are drawn by edges in times edges out, so none is an end, and those within cycles and hubs come up often.
    """
    ends = [near.select("node", "next", F.lit(False).alias("back")) for near in leave]
    turned = [near.select(F.col("next").alias("node"), F.col("node").alias("next"), F.lit(True).alias("back")) for near in leave]
    for parity in (0, 1):
        both = ends[parity].unionByName(turned[1 - parity]).select("*", _bucket())
        both.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{base}/both/parity={parity}")
    both = spark.read.schema("node string, next string, back boolean, parity int, bucket int").parquet(f"{base}/both")
    both = [both.filter(F.col("parity") == parity).drop("parity").withColumn("covered", F.lit(0)) for parity in (0, 1)]
    degrees = both[0].groupBy("node").agg((F.count_if("back") * F.count_if(~F.col("back"))).alias("weight"))
    drawn = weighted_sample(degrees, [], "node", "weight", 64).select("node", _bit(F.col("draw") - 1).alias("bits"))
    ways = F.explode(F.array(F.lit(False), F.lit(True))).alias("back")
    first = drawn.select("node", ways, F.lit(0).cast("long").alias("word"), "bits", F.lit(0).cast("long").alias("skip"))
    came = _spread(spark, f"{base}/landmarks", both, first)
    came.groupBy("node", "back").agg(F.bit_or("bits").alias("bits")).write.parquet(f"{base}/by_landmark")
    return spark.read.schema("node string, back boolean, bits long").parquet(f"{base}/by_landmark")


def lineage_impact(spark: SparkSession, edges: DataFrame, starts: DataFrame, direction: str = "downstream") -> DataFrame:
    """``node`` of ``starts`` and ``datasets``, the number of other datasets reachable from it, for all starts at once.

    A start is a bit of a 64-bit word, and a frontier row says which of a word's starts have just come to a node. Steps
    merge by bitwise or, so the edges are read once per step for all starts together, and a row serves 64 of them.
    A step keeps the bits a node did not have before; it ends when there are none. Cycles are fine, and a start
    without edges reaches 0. Everything between steps is a table in the shared folder.

    What many starts reach in common is walked once: first up to 64 landmarks, all in one word, find what they reach
    and what reaches them. A start that reaches a landmark reaches all behind it, so the starts of a word stop before
    nodes behind a landmark that they all reach, and those are counted per set of landmarks. Starts are put into words
    by the landmarks they reach. Which datasets are landmarks changes the work only, not the counts.
    """
    base = work_dir(spark, "impact")
    leave = _stored_edges(spark, edges, base, direction)
    at, none = _landmarks(spark, leave, base), F.lit(0).cast("long")
    behind = at.filter("NOT back").select("node", F.col("bits").alias("covered"))
    onto = leave[1].join(behind.withColumnRenamed("node", "at"), F.col("next").eqNullSafe(F.col("at")), "left")
    onto = onto.select("node", "next", "bucket", F.coalesce("covered", none).alias("covered"))
    onto.write.parquet(f"{base}/onto")
    onto = spark.read.schema("node string, next string, bucket int, covered long").parquet(f"{base}/onto")
    ahead = [near.withColumn("back", F.lit(False)) for near in (leave[0].withColumn("covered", none), onto)]

    # a set of landmarks that 64 starts or more reach has words of its own; in other words, those of all starts count
    reached = at.filter("back").select("node", F.col("bits").alias("landmarks"))
    starts = starts.select("node").distinct().join(reached, "node", "left").join(behind, "node", "left")
    starts = starts.select("node", F.coalesce("landmarks", none).alias("landmarks"), F.coalesce("covered", none).alias("covered"))
    often = starts.groupBy("landmarks").count().filter("count >= 64").select("landmarks", F.col("landmarks").alias("set"))
    starts = starts.join(often, "landmarks", "left").orderBy("set", "landmarks", "node")
    starts.select("*", F.monotonically_increasing_id().alias("number")).write.parquet(f"{base}/starts")
    starts = spark.read.parquet(f"{base}/starts")
    block, alike = F.shiftright("number", 6).alias("block"), F.bit_and("landmarks").alias("skip")
    words = starts.groupBy("set", block).agg(alike).select("*", F.monotonically_increasing_id().alias("word"))
    words.write.parquet(f"{base}/words")
    words = spark.read.parquet(f"{base}/words").withColumnRenamed("set", "of")
    starts = starts.select("*", block).join(words, ["block"]).filter("set <=> of")
    inside = F.col("covered").bitwiseAND(F.col("skip")) != 0
    starts = starts.select("node", "word", F.col("number").bitwiseAND(63).cast("int").alias("bit"), "skip", inside.alias("inside"))
    first = starts.filter("NOT inside").select("node", F.lit(False).alias("back"), "word", _bit(F.col("bit")).alias("bits"), "skip")
    came = _spread(spark, f"{base}/reached", ahead, first)

    counts = F.array(*[F.sum(F.shiftright("bits", i).bitwiseAND(1)) for i in range(64)]).alias("counts")
    alone = came.filter("step > 0").groupBy("word").agg(counts)
    alone = alone.select("word", F.posexplode("counts").alias("bit", "alone"))
    sets = behind.groupBy("covered").agg(F.count("*").alias("size"))
    # sets meet at every landmark in common and count at the first
    one = "explode(filter(sequence(0, 63), i -> getbit({}, i) = 1)) AS landmark"
    common = words.select("skip").distinct().select("skip", F.expr(one.format("skip")))
    common = common.join(sets.select("*", F.expr(one.format("covered"))), "landmark")
    common = common.filter("skip & covered & ~shiftleft(-1L, landmark) = 0").groupBy("skip").agg(F.sum("size").alias("common"))
    found = starts.join(alone, ["word", "bit"], "left").join(common, "skip", "left")
    # a start behind a landmark that it reaches is not another dataset
    others = F.coalesce("alone", none) + F.coalesce("common", none) - F.col("inside").cast("long")
    return found.select("node", others.alias("datasets"))


def job_status(events: DataFrame) -> DataFrame:
    """Last status per job, completed runs and their total duration in seconds."""
    at = F.unix_seconds(F.col("event_time").cast("timestamp"))
    done = F.max(F.when(F.col("event_type") == "COMPLETE", at))
    runs = events.groupBy("job", "run_id").agg(
        (done - F.min(F.when(F.col("event_type") == "START", at))).alias("seconds"),
        # order by time, then run, then type: a COMPLETE at the instant of its START comes later
        F.max(F.struct("event_time", "run_id", (F.col("event_type") != "START").alias("ended"), "event_type")).alias("last"),
    )
    return runs.groupBy("job").agg(
        F.max("last").getField("event_type").alias("status"),
        F.count("seconds").alias("completed_runs"),
        F.sum("seconds").alias("total_seconds"),
    )
