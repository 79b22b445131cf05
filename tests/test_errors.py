from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakestream.functions.hashing import changed_rows, fingerprint
from lakestream.functions.metrics import relabel
from lakestream.operators.errors import Check, fail_fast, retry, split_errors


def checks():
    return [
        Check("cast", "InvalidNumber", "not a number", F.col("v").try_cast("int").isNull() & F.col("v").isNotNull()),
        Check("route", "MissingRoute", "no target", F.col("t").isNull()),
    ]


@pytest.fixture
def records(spark):
    return spark.createDataFrame([("1", "a"), ("x", "a"), ("x", None), ("2", None), (None, "b")], "v string, t string")


def test_good_and_dead_letters_add_up(records):
    good, bad = split_errors(records, checks(), "sink", ["v"], F.lit("q_dlq"))
    assert [r["v"] for r in good.collect()] == ["1", None]
    assert [(r["v"], r["error_class"], r["dlq_topic"]) for r in bad.collect()] == [
        ("x", "InvalidNumber", "q_dlq"),
        ("x", "InvalidNumber", "q_dlq"),
        ("2", "MissingRoute", "q_dlq"),
    ]


def test_fail_fast(records):
    assert fail_fast(records.filter("v = '1'"), checks()).count() == 1
    with pytest.raises(PySparkException, match="MissingRoute: no target"):
        fail_fast(records.filter("v = '2'"), checks()).count()


class Clock:
    def __init__(self):
        self.now, self.pauses = 0.0, []

    def sleep(self, seconds):
        self.now += seconds
        self.pauses.append(seconds)


def test_retry_backs_off_and_gives_up():
    clock, calls = Clock(), []

    def failing():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        retry(failing, sleep=clock.sleep, clock=lambda: clock.now)
    assert clock.pauses[:7] == [1, 2, 4, 8, 16, 32, 60] and max(clock.pauses) == 60
    assert clock.now <= 300 and len(calls) == len(clock.pauses) + 1


def test_permanent_errors_are_not_retried(spark, records):
    clock = Clock()
    guarded = fail_fast(records, checks())
    for write in (guarded.count, lambda: spark.table("no_such_table").count()):
        with pytest.raises(PySparkException):
            retry(write, sleep=clock.sleep, clock=lambda: clock.now)
    assert clock.pauses == []


def test_retry_returns_the_first_success():
    clock, results = Clock(), iter([OSError("down"), "done"])

    def write():
        value = next(results)
        if isinstance(value, Exception):
            raise value
        return value

    assert retry(write, sleep=clock.sleep, clock=lambda: clock.now) == "done"
    assert clock.pauses == [1]


def test_relabel(spark):
    names = [
        "kafka.connect<type=task-error-metrics, connector=My-Sink, task=0><>total-record-errors",
        "kafka.connect<type=connect-worker-metrics><>task-count",
        "kafka.connect<type=sink-task-metrics, connector=b, task=1><>offset-commit-completion-total: 4",
        "kafka.connect<type=sink-task-metrics, connector=b, task=1><>put-batch-avg-time-ms",
    ]
    got = relabel(spark.createDataFrame([(n,) for n in names], "name string")).select("metric", "connector", "task")
    assert [tuple(r) for r in got.collect()] == [
        ("kafka_connect_task_error_total_record_errors", "My-Sink", "0"),
        ("kafka_connect_worker_task_count", None, None),
        ("kafka_connect_sink_task_offset_commit_completion_total", "b", "1"),
    ]


def test_fingerprints_tell_null_from_empty_and_columns_apart(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("", "a"), (None, "a"), ("a", None)], "x string, y string")
    prints = [r[0] for r in df.select(fingerprint([F.col("x"), F.col("y")])).collect()]
    assert len(set(prints)) == 4 and prints[0] == prints[4]
    assert all(len(p) == 16 and p == p.lower() for p in prints)


def test_changed_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    got = {r["k"]: r["change"] for r in changed_rows(old, new, ["k"], [F.col("v")]).collect()}
    assert got == {1: "removed", 2: "changed", 3: "same", 4: "added"}
