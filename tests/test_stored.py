"""Answers from stored parts: digests, sketches, bitmaps, samples, clustered files, state, and merged commits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestream.operators import drift, lineage
from lakestream.operators.lineage import lineage_closure, lineage_impact
from lakestream.operators.rollups import bitmaps, distinct_rollup, merge_sketches, read_sketches, sketches
from lakestream.operators.sampling import weighted_sample
from lakestream.session import stream_session, work_dir
from lakestream.sources import lake
from lakestream.sources.clustered import write_clustered
from lakestream.sources.stream import stage_files, stream_source
from lakestream.streaming.joins import keyed_join
from lakestream.streaming.sink import append_to, run_available, upsert_to, upsert_topics_to
from lakestream.streaming.snapshots import state_operators, state_rows

LEVELS = 3


def snapshot(spark, rows, leaf, name):
    path = f"{work_dir(spark, 'drift')}/{name}"
    df = spark.createDataFrame(rows, "id long, v string")
    drift.write_snapshot(df, path, ["id"], [F.col("v")], leaf, LEVELS, band_levels=1)
    return path


@pytest.mark.parametrize("ranged", [True, False])
def test_drift_equals_a_join_of_all_rows(spark, rows, ranged):
    leaf = drift.ranged_leaf("id", 0, 2, LEVELS) if ranged else drift.hashed_leaf(["id"], LEVELS)
    old = {i: f"v{i}" for i in range(-5, 3000)}
    new = {i: v for i, v in old.items() if i not in (7, 2999)} | {11: "x", 12: None, 9_999_999: "far", -9: "low"}
    paths = [snapshot(spark, list(side.items()), leaf, n) for side, n in ((old, "old"), (new, "new"))]
    found = drift.drift(spark, *paths, ["id"], LEVELS, band_levels=1)
    kinds = {i: "added" if i not in old else "removed" if i not in new else "changed" if old[i] != new[i] else "same" for i in old | new}
    assert rows(found.select("id", "change")) == sorted(kinds.items(), key=repr)
    changed = drift.drift(spark, *paths, ["id"], LEVELS, band_levels=1, same=False)
    assert {r["id"] for r in changed.collect()} == {7, 2999, 11, 12, 9_999_999, -9}
    leaves = drift.differing_nodes(spark, *paths, LEVELS).count()
    assert leaves <= 6 and drift.differing_nodes(spark, *paths, 0).count() == 1
    assert drift.drift(spark, paths[0], paths[0], ["id"], LEVELS, 1, same=False).count() == 0


def test_equal_ranges_are_not_joined(spark):
    leaf = drift.ranged_leaf("id", 0, 1, LEVELS)
    old = [(i, f"v{i}") for i in range(4000)]
    one, two = snapshot(spark, old, leaf, "one"), snapshot(spark, [*old[1:], (0, "x")], leaf, "two")
    # rows of an equal range that differ without their digests knowing: nobody looks at them
    spark.createDataFrame([(9_000, "p", 3_999, 15)], "id long, print string, leaf long, band long").write.partitionBy("band").mode(
        "append"
    ).parquet(f"{two}/rows")
    assert [r["id"] for r in drift.drift(spark, one, two, ["id"], LEVELS, 1, same=False).collect()] == [0]


def people(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.randrange(30), rng.choice([rng.randrange(70_000), None]), rng.random()) for _ in range(4000)]
    return data, spark.createDataFrame(data, "kind string, day int, user long, value double")


def test_sketches_of_days_serve_any_range(spark):
    data, df = people(spark)
    days = sketches(df, ["kind", "day"], "user", "value")
    some = read_sketches(merge_sketches(days.filter("day BETWEEN 3 AND 19"), ["kind"]), [0.1, 0.5, 0.9]).collect()
    for row in some:
        mine = [d for d in data if d[0] == row["kind"] and 3 <= d[1] <= 19]
        users, values = len({d[2] for d in mine} - {None}), sorted(d[3] for d in mine)
        assert row["n"] == len(mine) and abs(row["distinct"] - users) < 0.1 * users
        for f, q in zip((0.1, 0.5, 0.9), row["quantiles"], strict=True):
            assert abs(sum(v <= q for v in values) / len(values) - f) < 0.02


def test_bitmaps_are_exact_on_every_level(spark, rows):
    data, df = people(spark)
    stored = bitmaps(df, ["kind", "day"], "user")
    found = distinct_rollup(stored, ["kind", "day"], "users")
    df.createOrReplaceTempView("people")
    wanted = spark.sql("SELECT kind, day, count(*) n, count(DISTINCT user) users FROM people GROUP BY ROLLUP (kind, day)")
    assert rows(found.select(*wanted.columns)) == rows(wanted)
    assert rows(distinct_rollup(stored.limit(0), ["kind"], "users")) == []


def test_weighted_sample(spark):
    data = [(i, "big" if i < 2000 else "few" if i < 2003 else None, 9.0 if i % 2 else 1.0) for i in range(3000)]
    data += [(4000, "big", 0.0), (4001, "big", None), (None, "big", 5.0), (4002, "big", -1.0)]
    df = spark.createDataFrame(data, "id long, part string, w double")
    drawn = weighted_sample(df, ["part"], "id", "w", 200, seed=3)
    got = drawn.collect()
    sizes = {p: sorted(r["draw"] for r in got if r["part"] == p) for p in ("big", "few", None)}
    assert sizes == {"big": list(range(1, 201)), "few": [1, 2, 3], None: list(range(1, 201))}
    # with weights 9 to 1 and few drawn of many, nine of ten have the larger weight
    assert 160 <= sum(r["w"] == 9.0 for r in got if r["part"] == "big") <= 195
    again = weighted_sample(df.repartition(7), ["part"], "id", "w", 200, seed=3).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert "WindowGroupLimit" in drawn._jdf.queryExecution().executedPlan().toString()


def rows_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_clustered_files_skip_on_every_column(spark, rows):
    rng = random.Random(4)
    data = [(rng.randrange(1000), rng.choice([7, rng.randrange(1000)]), rng.random() if i % 50 else None, i) for i in range(20_000)]
    df = spark.createDataFrame(data, "a int, b long, c double, id long")
    path = work_dir(spark, "clustered")
    write_clustered(df, path, ["a", "b", "c"], files=64)
    stored = spark.read.parquet(path)
    assert rows(stored) == rows(df)
    for condition in ("a < 100", "b BETWEEN 800 AND 900", "c < 0.1"):
        chosen = stored.filter(condition)
        assert rows_read(chosen) < len(data) / 2
        assert chosen.count() == df.filter(condition).count()
    write_clustered(df.limit(0), work_dir(spark, "clustered"), ["a", "b"])
    for columns in (["a"], list("abcdefgh")):
        with pytest.raises(ValueError):
            write_clustered(df, path, columns)


def test_state_of_a_stopped_job_at_any_batch(spark, rows):
    base, session = work_dir(spark, "state"), stream_session(spark)
    for batch in range(3):
        stage_files(spark.range(100 * (batch + 1)).select((F.col("id") % 7).alias("k")), f"{base}/in", "k")
        counts = stream_source(session, f"{base}/in", T.StructType().add("k", "long"), bounded=False).groupBy("k").count()
        run_available(counts, upsert_to(f"{base}/t", ["k"], ["count"]), f"{base}/c", mode="update")
    for batch, n in ((0, 100), (1, 300), (2, 600), (None, 600)):
        assert state_rows(session, f"{base}/c", batch).agg(F.sum("count")).first()[0] == n
    assert rows(state_rows(session, f"{base}/c")) == rows(lake.read_upserted(spark, f"{base}/t", ["k"], ["count"]))
    assert state_operators(session, f"{base}/c").first()["operatorName"] == "stateStoreSave"


def test_keyed_join_reads_no_stored_rows(spark, rows, monkeypatch):
    """Sides come in any order, keys wait until both are known, and the newest right row holds."""
    base, session = work_dir(spark, "keyed"), stream_session(spark)
    schema = "k long, amount long, name string, offset long"
    batches = [
        [(1, 5, None, None), (2, 7, None, None), (None, 9, None, None)],
        [(1, None, "x", 1), (3, None, "z", 1), (None, None, "n", 1)],
        [(1, 6, None, None), (1, None, "old", 0), (2, None, "y", 2)],
        [(1, None, "new", 5), (3, 1, None, None)],
    ]
    sides = {
        "total": F.sum("amount"),
        "name": F.max_by("name", F.when(F.col("name").isNotNull(), F.col("offset"))),
        "n": F.count("amount"),
    }
    for batch in batches:
        rows_in = spark.createDataFrame(batch, schema)
        stage_files(rows_in, f"{base}/in", "k", files=1)
        stream = stream_source(session, f"{base}/in", rows_in.schema, bounded=False)
        monkeypatch.setattr(lake, "read_upserted", lambda *a, **b: pytest.fail("a stored table is read"))
        run_available(keyed_join(stream, ["k"], sides, ["total", "name"]), append_to(f"{base}/t"), f"{base}/c", mode="update")
        monkeypatch.undo()
    log = lake.read_log(spark, f"{base}/t")
    assert rows(log.select("commit", "k", "total", "name")) == sorted(
        [(1, 1, 5, "x"), (2, 1, 11, "x"), (2, 2, 7, "y"), (3, 1, 11, "new"), (3, 3, 1, "z")], key=repr
    )


def test_impact_of_every_start_is_its_closure(spark):
    rng = random.Random(6)
    data = {(f"d{rng.randrange(60)}", f"j{rng.randrange(25)}", "reads") for _ in range(80)}
    data |= {(f"j{rng.randrange(25)}", f"d{rng.randrange(60)}", "writes") for _ in range(40)}
    edges = spark.createDataFrame(sorted(data), "source string, target string, kind string")
    starts = spark.createDataFrame([(f"d{i}",) for i in range(70)] * 2, "node string").repartition(3)
    following = {}
    for a, b, _ in data:
        following.setdefault(a, set()).add(b)

    def reach(start):
        seen, todo = {start}, [start]
        while todo:
            for b in following.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return sum(n[0] == "d" for n in seen) - 1

    found = {r["node"]: r["datasets"] for r in lineage_impact(spark, edges, starts).collect()}
    assert found == {f"d{i}": reach(f"d{i}") for i in range(70)} and max(found.values()) > 5
    assert lineage_closure(spark, edges, "d0").filter("dataset != 'd0'").count() == found["d0"]


def test_what_all_starts_reach_is_walked_once(spark, tmp_path, monkeypatch):
    # 1,280 datasets lead into a cycle of two, and that to 1,000 more and a null; beside it, layers without cycles
    rng = random.Random(8)
    data = [(f"s{i}", f"a{i}", "reads") for i in range(1280)] + [(f"a{i}", f"c{i % 2}", "writes") for i in range(1280)]
    data += [("c0", "x", "reads"), ("x", "c1", "writes"), ("c1", "y", "reads"), ("y", "c0", "writes"), ("y", None, "writes")]
    data += [("y", f"z{i}", "writes") for i in range(1000)]
    jobs = [(f"l{n}_{rng.randrange(30)}", f"j{n}_{i}", f"l{n + 1}_{rng.randrange(30)}") for n in range(5) for i in range(40)]
    data += [(a, j, "reads") for a, j, _ in jobs] + [(j, b, "writes") for _, j, b in jobs]
    edges = spark.createDataFrame(data, "source string, target string, kind string")
    layers = {f"l{n}_{i}": {b for a, _, b in jobs if a == f"l{n}_{i}"} for n in range(6) for i in range(30)}
    expected = {f"s{i}": 1003 for i in range(1280)} | {"c0": 1002, "c1": 1002, "z0": 0, "nowhere": 0}
    for start in layers:
        seen = set()
        todo = [start]
        while todo:
            todo += (new := layers[todo.pop()] - seen)
            seen |= new
        expected[start] = len(seen)
    monkeypatch.setattr(lineage, "work_dir", lambda spark, label: f"{tmp_path}/{label}")
    starts = spark.createDataFrame([(n,) for n in expected], "node string")
    assert {r["node"]: r["datasets"] for r in lineage_impact(spark, edges, starts).collect()} == expected
    # a word of 64 starts each would write over 20,000 rows
    assert sum(spark.read.parquet(str(p)).count() for p in tmp_path.rglob("step=*")) < 10_000


def parts(spark, path):
    log = lake.read_table_log(spark, path)
    return log, log.chain()


def test_small_commits_rewrite_the_base_a_few_times_only(spark, monkeypatch):
    path, bases = work_dir(spark, "lake"), []
    keep = lake.write_partitioned
    monkeypatch.setattr(lake, "write_partitioned", lambda df, folder, by: (bases.append(folder), keep(df, folder, by)))
    wide = F.sha2(F.col("id").cast("string"), 512).alias("v")
    lake.upsert_commit(spark.range(20_000).select("id", F.lit(-1).alias("pos"), wide), path, 0, ["id"], ["pos"])
    lake.fold(spark, path, ["id"], ["pos"])
    bases.clear()
    for n in range(1, 65):
        lake.upsert_commit(spark.range(n, n + 3).select("id", F.lit(n).alias("pos"), F.lit("w").alias("v")), path, n, ["id"], ["pos"])
        lake.fold_when(spark, path, ["id"], ["pos"], every=4)
    log, chain = parts(spark, path)
    assert chain[0] == (-1, 0) and not any("base=" in b for b in bases)
    # runs follow each other, number the logarithm of the commits, and each was written from few others
    assert [a[1] for a in chain] == [b[0] for b in chain[1:]] + [chain[-1][1]] and len(chain) <= 6
    assert sum("run=" in b for b in bases) == 16 and len(log.newer()) < 4
    got = {r["id"]: r["pos"] for r in lake.read_upserted(spark, path, ["id"], ["pos"]).collect()}
    assert got == {i: min(i, 64) if 1 <= i <= 66 else -1 for i in range(20_000)}
    # replays of merged commits change nothing
    for n in (0, 3, 17, 64):
        lake.upsert_commit(spark.range(1).select("id", F.lit(999).alias("pos"), F.lit("again").alias("v")), path, n, ["id"], ["pos"])
    assert lake.read_upserted(spark, path, ["id"], ["pos"]).agg(F.max("pos")).first()[0] == 64


def test_a_table_that_doubles_rewrites_its_base(spark):
    path = work_dir(spark, "lake")
    for n in range(12):
        lake.upsert_commit(spark.range(100 * n, 100 * n + 100).withColumn("pos", F.lit(n)), path, n, ["id"], ["pos"])
        lake.fold_when(spark, path, ["id"], ["pos"], every=3)
    log, chain = parts(spark, path)
    assert chain[0][0] == -1 and log.newer() == [] and lake.read_upserted(spark, path, ["id"], ["pos"]).count() == 1200


def test_append_tables_merge_commits_and_keep_every_row(spark):
    path = work_dir(spark, "lake")
    sink = append_to(path, fold_every=4)
    for n in range(22):
        sink(spark.range(5).withColumn("n", F.lit(n % 2)), n)
    log, chain = parts(spark, path)
    assert len(log.newer()) < 4 and 1 <= len(chain) <= 4 and len(log.commits) < 16
    assert lake.read_log(spark, path).count() == 110
    sink(spark.range(5).withColumn("n", F.lit(0)), 2)
    assert lake.read_log(spark, path).count() == 110


def test_no_routed_record_is_lost(spark, rows):
    base = work_dir(spark, "t")
    schemas = {t: T.StructType().add("id", "long").add(c, k) for t, c, k in (("silver.a", "x", "integer"), ("silver.b", "y", "string"))}
    batch = [
        ("Silver.A", '{"id": 1, "x": 5}'), ("silver.a", '{"id": 2, "x": '), ("silver.a", None), ("silver.b", '{"id": 1, "y": "z"}'),
        ("silver.a", '{"id": 3, "x": "no number"}'), ("silver.zz", "{}"), (None, '{"id": 4}'), (None, None),
    ]
    commit = upsert_topics_to(base, "t", "value", schemas, ["id"], ["id"], f"{base}/dlq")
    commit(spark.createDataFrame(batch, "t string, value string"), 0)
    got = {t: [tuple(r) for r in lake.read_upserted(spark, f"{base}/{t}", ["id"], ["id"]).collect()] for t in schemas}
    assert got == {"silver.a": [(1, 5)], "silver.b": [(1, "z")]}
    assert rows(lake.read_log(spark, f"{base}/dlq").select("target", "error_class", "record")) == sorted(
        [
            ("silver.a", "BadRecord", '{"id": 2, "x": '), ("silver.a", "BadRecord", None), ("silver.a", "BadRecord", '{"id": 3, "x": "no number"}'),
            ("silver.zz", "UnknownTarget", "{}"), (None, "NoTarget", '{"id": 4}'), (None, "NoTarget", None),
        ],
        key=repr,
    )
