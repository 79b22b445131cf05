from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestream.operators import evolution
from lakestream.operators.latest import clean, compact, identity, latest_per_key, resolve_ids, upsert, upsert_small
from lakestream.operators.routing import fan_out, route_by_field
from lakestream.session import work_dir
from lakestream.sources import lake

SCHEMA = "id bigint, part string, pos bigint, v string"


def records(n=400, keys=20, seed=3):
    rng = random.Random(seed)
    return [(rng.choice([0, rng.randrange(keys)]), rng.choice("abc"), pos, f"v{pos}") for pos in range(n)]


def expected(data, key):
    best = {}
    for row in data:
        if key(row) not in best or best[key(row)][2] < row[2]:
            best[key(row)] = row
    return sorted(best.values(), key=repr)


@pytest.mark.parametrize("merge", [upsert, upsert_small])
@pytest.mark.parametrize("scope", ["global", "partition"])
@pytest.mark.parametrize("in_order", [True, False])
def test_batches_in_any_order_give_the_latest_rows(spark, rows, merge, scope, in_order):
    data = records()
    arrival = data if in_order else random.Random(1).sample(data, len(data))
    table = spark.createDataFrame([], SCHEMA)
    for i in range(0, len(arrival), 150):
        path = work_dir(spark, "merge")
        batch = spark.createDataFrame(arrival[i : i + 150], SCHEMA)
        merge(table, batch, ["id"], ["pos"], "part", scope).write.parquet(path)
        table = spark.read.parquet(path)
    key = (lambda r: r[0]) if scope == "global" else (lambda r: r[:2])
    assert rows(table) == expected(data, key)


@pytest.mark.parametrize("merge", [upsert, upsert_small])
def test_upsert_twice_changes_nothing_and_ties_go_to_the_batch(spark, rows, merge):
    table = spark.createDataFrame([(1, "a", 5, "old"), (None, "a", 5, "old")], SCHEMA)
    batch = spark.createDataFrame([(1, "a", 5, "new"), (None, "a", 6, "new"), (2, "a", 1, "new")], SCHEMA)
    once = merge(table, batch, ["id"], ["pos"])
    assert rows(once) == rows(merge(once, batch, ["id"], ["pos"]))
    assert {r["v"] for r in once.collect()} == {"new"} and once.count() == 3


def test_identity_columns():
    assert identity(["id"], "part", "partition") == ["id", "part"]
    assert identity(["id", "part"], "part", "partition") == ["id", "part"]
    assert identity(["id"], "part", "global") == ["id"]
    for bad in ((), "global"), (["id"], "other"):
        with pytest.raises(ValueError):
            identity(bad[0], None, bad[1])
    assert resolve_ids("t", {"t": ["a"]}, ["d"]) == ["a"]
    assert resolve_ids("u", {"t": ["a"]}, ["d"]) == ["d"]
    with pytest.raises(ValueError):
        resolve_ids("u", {}, [])


def test_commits_replay_and_fold(spark, rows):
    base, data = work_dir(spark, "lake"), records()
    for commit in (0, 1, 1, 0, 2):
        batch = spark.createDataFrame(data[commit::3], SCHEMA)
        lake.upsert_commit(batch, f"{base}/t", commit, ["id"], ["pos"], "part", "partition")
    options = {"ids": ["id"], "order": ["pos"], "partition_by": "part", "scope": "partition"}
    want = expected(data, lambda r: r[:2])
    got = lake.read_upserted(spark, f"{base}/t", **options).select("id", "part", "pos", "v")
    assert rows(got) == want
    upto = lake.read_upserted(spark, f"{base}/t", **options, upto=0).select("id", "part", "pos", "v")
    assert rows(upto) == expected(data[0::3], lambda r: r[:2])
    only = spark.createDataFrame([(0,)], "id bigint")
    assert {r["id"] for r in lake.read_upserted(spark, f"{base}/t", **options, only=only).collect()} == {0}
    last = lake.fold(spark, f"{base}/t", **options)
    folded = lake.read_log(spark, f"{base}/t")
    assert rows(folded.select("id", "part", "pos", "v")) == want
    assert [r[0] for r in folded.select("commit").distinct().collect()] == [last] == [2]
    # replays of folded batches change nothing, later ones go on top: a newer row, an outdated one and a new key
    later = [(0, "a", 10_000, "last"), (0, "b", -1, "outdated"), (99, "c", 1, "new")]
    for commit, batch in ((2, data[2::3]), (0, data[0::3]), (3, later), (3, later)):
        lake.upsert_commit(spark.createDataFrame(batch, SCHEMA), f"{base}/t", commit, ["id"], ["pos"], "part", "partition")
    for _ in range(3):
        got = lake.read_upserted(spark, f"{base}/t", **options).select("id", "part", "pos", "v")
        assert rows(got) == expected(data + later, lambda r: r[:2])
        lake.fold(spark, f"{base}/t", **options)
    assert lake.read_table_log(spark, f"{base}/t").newer() == []


def test_unfinished_commits_are_not_seen(spark):
    path = work_dir(spark, "lake")
    lake.append(spark.range(3), path, 0)
    lake.append(spark.range(3, 5), path, 1)
    spark.range(100).write.parquet(f"{path}/commit=2")
    assert lake.read_log(spark, path).count() == 5
    lake.append(spark.range(5, 6), path, 2)
    assert lake.read_log(spark, path).count() == 6


def test_empty_tables_are_read_with_their_schema(spark):
    path = work_dir(spark, "lake")
    with pytest.raises(FileNotFoundError):
        lake.read_log(spark, path)
    for partition_by in (None, "part"):
        path = work_dir(spark, "lake")
        lake.append(spark.createDataFrame([], SCHEMA), path, 0, partition_by)
        assert lake.read_upserted(spark, path, ["id"], ["pos"]).columns == ["id", "part", "pos", "v"]
        lake.append(spark.createDataFrame([(1, "x", 1, "a"), (2, None, 1, "b")], SCHEMA), path, 1, partition_by)
        assert lake.read_log(spark, path).count() == 2
        lake.fold(spark, path, ["id"], ["pos"], partition_by)
        assert lake.read_log(spark, path).count() == 2


def test_folded_table_is_read_without_a_shuffle(spark):
    base = work_dir(spark, "lake")
    lake.upsert_commit(spark.range(1000).withColumn("pos", F.lit(0)), f"{base}/t", 0, ["id"], ["pos"])
    lake.fold(spark, f"{base}/t", ["id"], ["pos"])
    lake.upsert_commit(spark.range(5).withColumn("pos", F.lit(1)), f"{base}/t", 1, ["id"], ["pos"])
    df = lake.read_upserted(spark, f"{base}/t", ["id"], ["pos"])
    assert df.agg(F.sum("pos")).first()[0] == 5 and df.count() == 1000
    plan = df._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index("Union") : plan.index("BroadcastExchange")]
    assert "LeftAnti" in kept and "FileScan" in kept and "Exchange hashpartitioning" not in kept


def test_evolution_types():
    def struct(*fields):
        return T.StructType([T.StructField(n, t, False) for n, t in fields])

    old = struct(("a", T.IntegerType()), ("b", T.FloatType()), ("d", T.DecimalType(10, 2)), ("gone", T.StringType()))
    new = struct(("a", T.LongType()), ("b", T.DoubleType()), ("d", T.DecimalType(12, 2)), ("n", struct(("x", T.IntegerType()))))
    evolved = evolution.evolve(old, new)
    assert [f.dataType.simpleString() for f in evolved] == ["bigint", "double", "decimal(12,2)", "string", "struct<x:int>"]
    assert all(f.nullable for f in evolved) and evolved["n"].dataType["x"].nullable
    # narrower batches do not shrink the table
    assert evolution.evolve(evolved, old)["a"].dataType == T.LongType()
    for changed in (T.StringType(), T.FloatType()):
        with pytest.raises(evolution.IncompatibleSchema):
            evolution.evolve(struct(("a", T.IntegerType())), struct(("a", changed)))


def test_evolving_table(spark, rows):
    path = work_dir(spark, "evolving")
    lake.append(spark.createDataFrame([(1, "x")], "a int, b string"), path, 0)
    lake.append(spark.createDataFrame([(1 << 40, 2.5)], "a bigint, c double"), path, 1)
    lake.append(spark.createDataFrame([(3,)], "a int"), path, 2)
    with pytest.raises(evolution.IncompatibleSchema):
        lake.append(spark.createDataFrame([("x",)], "a string"), path, 3)
    got = lake.read_log(spark, path).select("a", "b", "c")
    assert rows(got) == sorted([(1, "x", None), (1 << 40, None, 2.5), (3, None, None)], key=repr)


def test_compaction_and_retention(spark):
    now = datetime(2024, 1, 31)
    data = [(key, i, now - timedelta(days=i)) for key in (1, 2) for i in range(20)]
    undated = spark.createDataFrame([(1, 1, None), (1, 2, None), (None, 3, None)], "k int, pos int, ts timestamp_ntz")
    log = spark.createDataFrame([(k, 100 - i, t) for k, i, t in data], "k int, pos int, ts timestamp_ntz")
    at = F.lit(str(now)).cast("timestamp_ntz")
    kept = compact(log, ["k"], "pos", "ts", at).collect()
    assert sorted((r["k"], r["pos"]) for r in kept) == [(k, p) for k in (1, 2) for p in range(92, 101)]
    args = (["k"], "pos", "ts", at, timedelta(days=3))
    assert clean(log, "delete", *args).count() == 8
    assert clean(log, "compact,delete", *args).count() == 8
    assert clean(log, "compact", *args).count() == 18
    # what has no time has no age
    for policy in ("delete", "compact", "compact,delete"):
        assert clean(undated, policy, *args).count() == 3
    with pytest.raises(ValueError):
        clean(log, "shrink", *args)


def test_routing(spark):
    df = spark.createDataFrame([("Silver.A",), (None,)], "t string")
    assert [r["target"] for r in route_by_field(df, "t").collect()] == ["silver.a", None]
    assert fan_out(df, ["X.a", "x.b"]).count() == 4
    with pytest.raises(ValueError):
        fan_out(df, [])


def test_latest_row_is_limited_before_the_shuffle(spark):
    df = latest_per_key(spark.createDataFrame(records(), SCHEMA), ["id"], ["pos"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
