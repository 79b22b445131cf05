"""Streams against the batch result, for several batch counts, replays, restarts and bad records."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestream.operators.errors import Check
from lakestream.operators.latest import current_rows, latest_per_key
from lakestream.session import stream_session, work_dir
from lakestream.operators.evolution import IncompatibleSchema
from lakestream.sources.lake import read_log, read_table_log, read_upserted
from lakestream.sources.stream import stage_files, stream_source
from lakestream.streaming.jobs import checkpoint_for, run_code_job, run_sql_job, statements
from lakestream.streaming.joins import maintain_join, merge_aggregate
from lakestream.streaming.progress import metered, watched
from lakestream.streaming.sink import (
    append_to,
    run_available,
    split_to,
    start,
    strict_to,
    upsert_routed_to,
    upsert_to,
    upsert_topics_to,
)

SCHEMA = "id bigint, pos bigint, place bigint, v string, t string"


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(11)
    data = [
        (rng.choice([0, rng.randrange(30)]), pos, rng.randrange(1000), f"v{pos}" if pos % 40 else None, rng.choice(["A.x", "a.y", None]))
        for pos in range(500)
    ]
    return spark.createDataFrame(data, SCHEMA).checkpoint()


def stream_of(spark, records, base, order, files=8, per_trigger=2):
    stage_files(records, f"{base}/in", order, files)
    return stream_source(stream_session(spark), f"{base}/in", records.schema, per_trigger)


@pytest.mark.parametrize("order", ["pos", "place"])
@pytest.mark.parametrize("per_trigger", [1, 3, 8])
def test_upsert_stream_equals_batch(spark, records, rows, order, per_trigger):
    base = work_dir(spark, "t")
    stream = stream_of(spark, records, base, order, per_trigger=per_trigger)
    query = run_available(stream, upsert_to(f"{base}/t", ["id"], ["pos"]), f"{base}/c")
    assert len(query.recentProgress) >= 8 // per_trigger
    got = read_upserted(spark, f"{base}/t", ["id"], ["pos"]).select(*records.columns)
    assert rows(got) == rows(latest_per_key(records, ["id"], ["pos"]))


def test_lost_checkpoint_replays_without_duplicates(spark, records, rows):
    base = work_dir(spark, "t")
    stream = stream_of(spark, records, base, "pos")
    for run in ("c", "again"):
        run_available(stream, append_to(f"{base}/t"), f"{base}/{run}")
    assert rows(read_log(spark, f"{base}/t").drop("commit")) == rows(records)


def test_interval_trigger(spark, records):
    base = work_dir(spark, "t")
    query = start(stream_of(spark, records, base, "pos", per_trigger=8), append_to(f"{base}/t"), f"{base}/c", interval=1)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert read_log(spark, f"{base}/t").count() == records.count()


def test_routed_stream(spark, records, rows):
    base = work_dir(spark, "t")
    commit = upsert_routed_to(f"{base}/t", "t", ["id"], ["pos"])
    run_available(stream_of(spark, records, base, "place"), commit, f"{base}/c")
    got = read_upserted(spark, f"{base}/t", ["id"], ["pos"], "target", "partition").select("target", "id", "pos")
    want = records.filter("t IS NOT NULL").groupBy(F.lower("t").alias("target"), "id").agg(F.max("pos").alias("pos"))
    assert rows(got) == rows(want)


def bad_value():
    return [Check("decode", "NoValue", "v is null", F.col("v").isNull())]


def test_tolerant_and_strict_sinks(spark, records):
    base = work_dir(spark, "t")
    stream = stream_of(spark, records, base, "pos")
    commit = split_to(append_to(f"{base}/good"), f"{base}/dlq", bad_value(), "sink", ["id", "pos"], F.lit("t_dlq"))
    run_available(stream, commit, f"{base}/c1")
    bad = records.filter("v IS NULL").count()
    assert read_log(spark, f"{base}/dlq").count() == bad > 0
    assert read_log(spark, f"{base}/good").count() == records.count() - bad
    with pytest.raises(StreamingQueryException, match="NoValue"):
        run_available(stream, strict_to(append_to(f"{base}/strict"), bad_value()), f"{base}/c2")


def test_restart_modes(spark):
    base = work_dir(spark, "t")
    spark.range(3).write.parquet(f"{base}/old")
    assert checkpoint_for(spark, "last-state", "a", "b") == "a"
    assert checkpoint_for(spark, "stateless", "a", "b") == "b"
    assert checkpoint_for(spark, "savepoint", "a", f"{base}/copy", f"{base}/old") == f"{base}/copy"
    assert spark.read.parquet(f"{base}/copy").count() == 3
    for mode in ("savepoint", "other"):
        with pytest.raises(ValueError):
            checkpoint_for(spark, mode, "a", "b")


def numbers_job(session, params):
    return session.range(int(params["n"]))


def test_script_and_code_jobs(spark):
    plain = """
      -- a comment; with a semicolon
      CREATE OR REPLACE TEMPORARY VIEW small AS SELECT id, ';' AS mark FROM numbers WHERE id < CAST(top AS INT);
      SELECT count(*) AS n FROM small /* ; */ WHERE mark = ';'
    """
    for script in (plain, f"BEGIN {plain}; END"):
        jobs = [
            run_sql_job(spark, script, {"top": "4"}, {"numbers": lambda s, n=n: s.range(n)}) for n in (10, 3)
        ]
        # two jobs with the same names side by side
        assert [job.first()["n"] for job in jobs] == [4, 3]
    assert not spark.catalog.tableExists("small")
    assert statements("a;b ';' ;;\n-- c;\n`d;e`") == ["a", "b ';'", "`d;e`"]
    with pytest.raises(ValueError):
        run_sql_job(spark, " -- nothing\n;")
    assert run_code_job(spark, lambda s, p: s.range(int(p["n"])), {"n": "7"}).count() == 7
    assert run_code_job(spark, "tests.test_streaming:numbers_job", {"n": "5"}).count() == 5
    for bad in ("tests.test_streaming:missing", "tests.test_streaming"):
        with pytest.raises(ValueError):
            run_code_job(spark, bad)
    with pytest.raises(TypeError):
        run_code_job(spark, lambda s, p: 3)


def test_merged_aggregate_is_safe_to_replay(spark):
    path = work_dir(spark, "t") + "/agg"
    merges = {"n": F.sum("n"), "top": F.max("top")}
    batches = [[(1, 2, 5), (2, 1, 1), (None, 1, 1)], [(1, 1, 9)], [(2, 4, 0), (3, 1, 1), (None, 1, 2)]]
    for commit in (0, 1, 1, 2, 2):
        delta = spark.createDataFrame(batches[commit], "k int, n long, top int")
        merge_aggregate(delta, path, commit, ["k"], merges)
    got = {r["k"]: (r["n"], r["top"]) for r in read_upserted(spark, path, ["k"], []).collect()}
    assert got == {1: (3, 9), 2: (5, 1), 3: (1, 1), None: (2, 2)}


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_maintained_join_equals_batch_join(spark, rows, how):
    base = work_dir(spark, "t")
    rng = random.Random(4)
    left_schema, right_schema = "k int, a string, version long, __deleted string", "k int, b string, version long, __deleted string"
    all_left, all_right = [], []
    for commit in range(4):
        left = [(rng.choice([None, *range(12)]), f"a{commit}{i}", commit * 10 + i, rng.choice(["false", "false", "true"])) for i in range(5)]
        right = [(rng.choice([None, *range(12)]), f"b{commit}{i}", commit * 10 + i, rng.choice(["false", "false", "true"])) for i in range(5)]
        # one side of the first batches is empty
        left, right = [] if commit == 0 and how == "full" else left, [] if commit == 0 and how != "full" else right
        all_left += left
        all_right += right
        for _ in range(2 if commit == 2 else 1):
            maintain_join(
                spark.createDataFrame(left, left_schema),
                spark.createDataFrame(right, right_schema),
                f"{base}/l",
                f"{base}/r",
                f"{base}/out",
                commit,
                ["k"],
                ["version"],
                how,
            )
        got = current_rows(read_upserted(spark, f"{base}/out", ["k"], [])).select("k", "a", "b")
        a = current_rows(latest_per_key(spark.createDataFrame(all_left, left_schema), ["k"], ["version"])).select("k", "a")
        b = current_rows(latest_per_key(spark.createDataFrame(all_right, right_schema), ["k"], ["version"])).select("k", "b")
        assert rows(got) == rows(a.join(b, "k", how))


def test_upsert_sink_folds_as_it_goes(spark, records, rows):
    base = work_dir(spark, "t")
    stream = stream_of(spark, records, base, "place", per_trigger=1)
    sink = upsert_to(f"{base}/t", ["id"], ["pos"], fold_every=3)
    run_available(stream, sink, f"{base}/c")
    log = read_table_log(spark, f"{base}/t")
    assert log.base is not None and len(log.newer()) < 3 and len(log.commits) < 8
    got = read_upserted(spark, f"{base}/t", ["id"], ["pos"]).select(*records.columns)
    assert rows(got) == rows(latest_per_key(records, ["id"], ["pos"]))
    # a lost checkpoint replays every batch: the folded and the newer ones are known
    run_available(stream, sink, f"{base}/again")
    got = read_upserted(spark, f"{base}/t", ["id"], ["pos"]).select(*records.columns)
    assert rows(got) == rows(latest_per_key(records, ["id"], ["pos"]))


def test_batches_that_do_not_fit_become_dead_letters(spark):
    base = work_dir(spark, "t")
    sink = upsert_to(f"{base}/t", ["id"], ["id"], dlq_path=f"{base}/dlq")
    sink(spark.range(3), 0)
    sink(spark.createDataFrame([("x",)], "id string"), 1)
    sink(spark.range(3, 4), 2)
    assert read_upserted(spark, f"{base}/t", ["id"], ["id"]).count() == 4
    letter = read_log(spark, f"{base}/dlq").first()
    assert letter["record"] == '{"id":"x"}' and letter["error_class"] == "IncompatibleSchema"
    with pytest.raises(IncompatibleSchema):
        upsert_to(f"{base}/t", ["id"], ["id"])(spark.createDataFrame([("x",)], "id string"), 3)


def test_topics_with_schemas_of_their_own(spark):
    base = work_dir(spark, "t")
    schemas = {t: T.StructType().add("id", "long").add(c, k) for t, c, k in (("silver.a", "x", "integer"), ("silver.b", "y", "string"))}
    batch = spark.createDataFrame(
        [("Silver.A", '{"id": 1, "x": 5}'), ("silver.b", '{"id": 1, "y": "z"}'), ("silver.c", "{}"), (None, None)], "t string, value string"
    )
    upsert_topics_to(base, "t", "value", schemas, ["id"], ["id"])(batch, 0)
    got = {t: [tuple(r) for r in read_upserted(spark, f"{base}/{t}", ["id"], ["id"]).collect()] for t in schemas}
    assert got == {"silver.a": [(1, 5)], "silver.b": [(1, "z")]}


def test_progress_sums_all_batches(spark, records):
    base = work_dir(spark, "t")
    stage_files(records, f"{base}/in", "pos", 8)
    session = stream_session(spark)
    session.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    stream = stream_source(session, f"{base}/in", records.schema, 1)
    with watched(session) as progress:
        counted = metered(stream, "sink", {"n": F.count("*"), "bad": F.count_if(F.col("v").isNull())})
        progress.wait(run_available(counted, append_to(f"{base}/t"), f"{base}/c"))
    assert progress.rows_read == progress.observed["sink.n"] == records.count()
    assert progress.observed["sink.bad"] == records.filter("v IS NULL").count()
