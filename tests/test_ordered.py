"""Split windows against brute force, on data in which one key holds most rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakestream.operators.ordered import (
    halo,
    last_known,
    micros,
    null_safe_join,
    number_rows,
    over_positions,
    packed,
    quantile_positions,
    ranked,
    running_sums,
    sums_between,
)
from lakestream.operators.temporal import asof_join, interval_join, range_join, sessionize

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", params=[0, 1, 2])
def events(spark, request):
    rng = random.Random(request.param)
    data = []
    for i in range(600):
        user = 0 if rng.random() < 0.6 else rng.choice([None, *range(8)])
        # bursts, quiet days and equal instants
        at = START + timedelta(days=rng.choice([0, 0, 1, 5, 9]), seconds=rng.randrange(0, 86_400, 600))
        at = None if rng.random() < 0.08 else at
        data.append((user, i, at, rng.choice([None, rng.randrange(10)]), rng.choice("abc")))
    return spark.createDataFrame(data, "u int, id int, ts timestamp_ntz, v int, kind string").checkpoint()


def chunked(events, rows=20):
    return packed(events, ["u"], micros(F.col("ts")), "id", rows=rows).withColumnRenamed("_chunk", "part")


def by_time(*more):
    return Window.partitionBy("u").orderBy(F.col("ts").asc_nulls_last(), *more)


def same(left, right, columns):
    a, b = (sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) for df in (left, right))
    assert a == b


def test_numbers_and_running_sums(events):
    w = by_time("id")
    want = events.withColumn("rn", F.row_number().over(w)).withColumn("total", F.sum(F.coalesce("v", F.lit(0))).over(w))
    order = [F.col("ts").asc_nulls_last(), F.col("id")]
    got = number_rows(chunked(events), ["u"], "part", order)
    got = running_sums(got, ["u"], "part", order, {"total": F.coalesce("v", F.lit(0))})
    same(got, want, ["id", "rn", "total"])


def test_lag_lead_and_frames(events):
    w = by_time("id")
    want = events.select(
        "id",
        F.lag("v").over(w).alias("before"),
        F.lead("v", 2).over(w).alias("after"),
        F.sum("v").over(w.rowsBetween(-3, 1)).alias("near"),
    )
    numbered = number_rows(chunked(events), ["u"], "part", [F.col("ts").asc_nulls_last(), F.col("id")])
    frames = {"before": (F.min("v"), -1, -1), "after": (F.min("v"), 2, 2), "near": (F.sum("v"), -3, 1)}
    for width in (4, 64, 4096):
        same(over_positions(numbered, ["u"], "rn", frames, width), want, want.columns)
    with pytest.raises(ValueError):
        halo(numbered, "rn", 2, before=3)


def test_last_known_and_asof(events):
    timed = events.filter("ts IS NOT NULL")
    w = Window.partitionBy("u").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = timed.withColumn("known", F.last("v", ignorenulls=True).over(w))
    same(last_known(chunked(timed), ["u"], "part", ["ts", "id"], "v", "known"), want, ["id", "known"])

    left = events.filter("kind = 'a'").select("u", "ts", "id")
    right = events.filter("kind = 'b'").select("u", "ts", "id", F.col("v").alias("rv"))
    rights = right.dropna(subset=["u", "ts"]).collect()
    for forward in (False, True):
        got = {r["id"]: r["rv"] for r in asof_join(left, right, ["u"], "ts", "id", ["rv"], forward, rows=10).collect()}
        rows = left.collect()
        assert len(got) == len(rows)
        for row in rows:
            near = [r for r in rights if r["u"] == row["u"] and row["ts"] and (r["ts"] > row["ts"] if forward else r["ts"] <= row["ts"])]
            best = (min if forward else max)((r["ts"] for r in near), default=None)
            # of several at the nearest instant, the one next to the left row in the order of ids
            values = [r["rv"] for r in sorted(near, key=lambda r: r["id"]) if r["ts"] == best]
            assert got[row["id"]] == (values[-1] if values else None)


def test_interval_join(events):
    left, right = (events.filter(F.col("kind") == kind).select("u", "ts", "id") for kind in "ab")
    got = interval_join(left, right, ["u"], "ts", "id", 7200, "n", "first", rows=10)
    pairs = left.alias("l").join(
        right.alias("r"),
        (F.col("l.u") == F.col("r.u"))
        & (F.col("r.ts") > F.col("l.ts"))
        & (F.col("r.ts") <= F.col("l.ts") + F.expr("interval 2 hours")),
        "left",
    )
    first = F.min(F.unix_micros(F.col("r.ts").cast("timestamp")))
    want = pairs.groupBy("l.id").agg(F.count("r.ts").alias("n"), first.alias("first"))
    same(got, want, ["id", "n", "first"])


@pytest.mark.parametrize("gap", [600, 1800, 50_000, 200_000])
def test_sessions(events, gap):
    w = by_time("id")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    fresh = F.coalesce((at - F.lag(at).over(w) >= gap).cast("int"), F.lit(1))
    want = (
        events.withColumn("fresh", fresh)
        .withColumn("sid", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("u", "sid")
        .agg(F.min("ts").alias("session_start"), F.count("*").alias("n"), F.sum("v").alias("total"))
    )
    got = sessionize(events, ["u"], "ts", "id", gap, {"n": F.lit(1), "total": F.col("v")}, rows=15)
    same(got, want, ["u", "session_start", "n", "total"])


def test_percentiles_and_ranks(spark, events):
    fractions = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    bare = spark.createDataFrame([(99, 10_000, None, None, "a")], events.schema)
    got = quantile_positions(events.unionByName(bare), ["u"], "v", F.floor(F.col("v") / 3), fractions).toPandas()
    got = got.assign(u=got["u"].fillna(-1)).set_index("u")
    table = events.toPandas().dropna(subset=["v"])
    want = table.assign(u=table["u"].fillna(-1)).groupby("u")["v"].quantile(fractions).unstack()
    assert set(got.index) == {*want.index, 99} and got.loc[99].isna().all()
    for f in fractions:
        assert got.loc[want.index, f"p{round(f * 100)}"].tolist() == pytest.approx(want[f].tolist())

    values = events
    by_value = Window.partitionBy("u").orderBy(F.col("v").desc_nulls_last())
    by_row = Window.partitionBy("u").orderBy(F.col("v").desc_nulls_last(), "id")
    want = values.select(
        "id",
        F.rank().over(by_value).alias("rank"),
        F.dense_rank().over(by_value).alias("dense_rank"),
        F.percent_rank().over(by_value).alias("percent_rank"),
        F.cume_dist().over(by_value).alias("cume_dist"),
        F.row_number().over(by_row).alias("row_number"),
        F.ntile(4).over(by_row).alias("ntile"),
    )
    got = ranked(values, ["u"], "v", F.floor(F.col("v") / 3), "id", 4)
    same(got, want, want.columns)
    # a frequent value in many chunks of its rows
    far = values.withColumn("id", F.col("id") * 1000)
    got = ranked(far, ["u"], "v", F.floor(F.col("v") / 3), "id", 4, rows=5).withColumn("id", F.floor(F.col("id") / 1000))
    same(got, want, want.columns)


def test_range_join(spark):
    points = spark.createDataFrame([(float(p),) for p in range(100)], "p double")
    ranges = [(0.0, 10.0, "a"), (5.0, 37.5, "b"), (90.0, 200.0, "c"), (-1e12, 1e12, "wide"), (3.0, 3.0, "none"), (None, 9.0, "null")]
    ranges = spark.createDataFrame(ranges, "lo double, hi double, name string")
    got = range_join(points.unionByName(spark.createDataFrame([(None,)], "p double")), ranges, "p", "lo", "hi", 7.0)
    want = points.join(ranges, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi")))
    same(got, want, ["p", "name"])


def test_sums_between_are_range_frames(events):
    timed = events.filter("ts IS NOT NULL").select("u", "id", micros(F.col("ts")).alias("at"), "v")
    w = Window.partitionBy("u").orderBy("at").rangeBetween(-3_600_000_000, 1_800_000_000)
    want = timed.select("id", F.count("*").over(w).alias("n"), F.sum("v").over(w).alias("total"))
    got = sums_between(timed, timed, ["u"], "at", -3_600_000_000, 1_800_000_000, {"n": F.lit(1), "total": F.col("v")}, rows=10)
    same(got, want.withColumn("total", F.coalesce("total", F.lit(0))), ["id", "n", "total"])


def test_null_keys_meet_in_joins(spark, rows):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, x int")
    b = spark.createDataFrame([(None, 3), (2, 4)], "k int, y int")
    assert rows(null_safe_join(a, b, ["k"])) == [(None, 1, 3)]
    assert rows(null_safe_join(a, b, ["k"], "left")) == [(1, 2, None), (None, 1, 3)]
    assert rows(null_safe_join(a, b, ["k"], "left_anti")) == [(1, 2)]


def test_a_busy_day_is_cut_by_its_rows(spark):
    """One key, one day, most rows within a minute: no chunk is larger than its bound and one slice."""
    rng = random.Random(7)
    data = [(1, i, START + timedelta(seconds=rng.randrange(60) if i % 10 else rng.randrange(86_400))) for i in range(20_000)]
    data += [(1, 20_000 + i, None) for i in range(10_000)]
    chunks = packed(spark.createDataFrame(data, "u int, id int, ts timestamp_ntz"), ["u"], micros(F.col("ts")), "id", rows=1000)
    sizes = [r["count"] for r in chunks.groupBy("u", "_chunk").count().collect()]
    slices = max(r["count"] for r in chunks.filter("ts IS NOT NULL").groupBy("ts").count().collect())
    assert sum(sizes) == 30_000 and max(sizes) <= 1000 + max(slices, 4096)
    # chunks follow the order
    order = [(r["_chunk"], r["ts"] or datetime.max) for r in chunks.collect()]
    assert [t for _, t in sorted(order)] == sorted(t for _, t in order)


@pytest.mark.parametrize("rows", [1, 100])
def test_equal_left_rows_stay_apart(spark, rows):
    left = spark.createDataFrame([(1, 10), (1, 10), (1, 12), (2, 5)], "u int, p long")
    right = spark.createDataFrame([(1, 9, 3), (1, 10, 4), (1, 11, 5), (2, 99, 1)], "u int, p long, w int")
    got = sums_between(left, right, ["u"], "p", -1, 0, {"w": F.col("w")}, rows=rows)
    assert sorted((r["u"], r["p"], r["w"]) for r in got.collect()) == [(1, 10, 7), (1, 10, 7), (1, 12, 5), (2, 5, 0)]
    at = lambda df: df.select("u", F.timestamp_seconds("p").cast("timestamp_ntz").alias("ts"))
    got = interval_join(at(left), at(right), ["u"], "ts", "u", 1, "n", "first", rows=rows)
    assert sorted((r["u"], r["ts"].second, r["n"]) for r in got.collect()) == [(1, 10, 1), (1, 10, 1), (1, 12, 0), (2, 5, 0)]


def test_short_keys_take_no_join_for_their_chunks(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("u"), "id")
    plan = packed(df, ["u"], F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
