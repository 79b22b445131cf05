from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakestream.operators.errors import split_errors
from lakestream.operators.governance import (
    check_compat,
    conform,
    conformance,
    conformance_checks,
    effective_level,
    latest_schema,
)
from lakestream.operators.lineage import job_status, lineage_closure, lineage_edges

VERSION = "subject string, version long, field string, type string, nullable boolean, has_default boolean"

# change of one field from version 1 to 4 (2 and 3 were deleted), and the levels it breaks
CHANGES = {
    "same": (("int", False, False), ("int", False, False), set()),
    "added": (None, ("int", False, False), {"BACKWARD", "FULL"}),
    "added with default": (None, ("int", False, True), set()),
    "removed": (("int", False, False), None, {"FORWARD", "FULL"}),
    "removed with default": (("int", False, True), None, set()),
    "widened": (("int", False, False), ("long", False, False), {"FORWARD", "FULL"}),
    "narrowed": (("double", False, False), ("float", False, False), {"BACKWARD", "FULL"}),
    "retyped": (("string", False, False), ("int", False, False), {"BACKWARD", "FORWARD", "FULL"}),
    "made nullable": (("int", False, False), ("int", True, False), {"FORWARD", "FULL"}),
    "made required": (("int", True, False), ("int", False, False), {"BACKWARD", "FULL"}),
}


@pytest.mark.parametrize("width", [2, 4096])
@pytest.mark.parametrize("level", ["NONE", "BACKWARD", "FORWARD", "FULL"])
def test_levels(spark, level, width):
    data = []
    for name, (old, new, _) in CHANGES.items():
        for version, form in ((1, old), (4, new)):
            data.append((name, version, "id", "long", False, False))
            if form:
                data.append((name, version, "f", *form))
    versions = spark.createDataFrame(data, VERSION)
    levels = spark.createDataFrame([(n, level) for n in CHANGES], "subject string, level string")
    got = {r["subject"]: r["ok"] for r in check_compat(versions, levels, width).collect()}
    assert got == {n: level not in broken for n, (_, _, broken) in CHANGES.items()}


def test_default_and_unknown_levels(spark):
    data = [("s", 1, "a", "int", False, False), ("s", 2, "a", "string", False, False)]
    versions = spark.createDataFrame(data, VERSION)
    none = spark.createDataFrame([("s", None), ("t", "FULL")], "subject string, level string")
    for levels in (none, none.filter("subject = 't'")):
        assert [(r["level"], r["ok"]) for r in check_compat(versions, levels).collect()] == [("BACKWARD", False)]
    with pytest.raises(Exception, match="unknown compatibility level: BACKWARD_TRANSITIVE"):
        check_compat(versions, spark.createDataFrame([("s", "BACKWARD_TRANSITIVE")], "subject string, level string")).collect()


def test_records_that_do_not_conform_become_dead_letters(spark):
    df = spark.createDataFrame([("1", "x"), (None, "2"), ("3", None)], "a string, b string")
    checks = conformance_checks({"a": ("int", True), "b": ("int", False)})
    good, bad = split_errors(df, checks, "c", ["a", "b"], F.lit("dlq"))
    assert [tuple(r) for r in good.collect()] == [("3", None)]
    assert [(r["a"], r["error_class"], r["error_message"]) for r in bad.collect()] == [
        ("1", "WrongType", "b:type"), (None, "MissingField", "a:missing")
    ]


def test_closure_goes_on_to_the_end_of_a_chain(spark):
    edges = [(f"d{i}", f"j{i}", "reads") for i in range(45)] + [(f"j{i}", f"d{i + 1}", "writes") for i in range(45)]
    reached = lineage_closure(spark, spark.createDataFrame(edges, "source string, target string, kind string"), "d0")
    assert {tuple(r) for r in reached.collect()} == {(f"d{i}", i) for i in range(1, 46)}


def test_first_versions_are_not_checked_and_violations_are_listed(spark):
    data = [("s", 1, "a", "int", False, False), ("s", 2, "a", "string", False, False), ("s", 2, "b", "int", False, False)]
    levels = spark.createDataFrame([("s", "FULL")], "subject string, level string")
    got = check_compat(spark.createDataFrame(data, VERSION), levels).collect()
    assert [(r["version"], r["violations"]) for r in got] == [
        (2, "a:type not readable, a:type not readable by old, b:added without default")
    ]


def test_effective_level_and_latest_schema(spark):
    df = spark.createDataFrame([("FULL", "NONE"), (None, "NONE"), (None, None)], "s string, l string")
    assert [r[0] for r in df.select(effective_level(F.col("s"), F.col("l"))).collect()] == ["FULL", "NONE", "BACKWARD"]
    versions = spark.createDataFrame(
        [("t-value", 1, "a", "int", False, False), ("t-value", 3, "b", "int", False, False), ("t-value", 3, "a", "long", False, False)],
        VERSION,
    )
    topics = spark.createDataFrame([("t",), ("u",)], "topic string")
    got = {r["topic"]: (r["version"], r["fields"], r["schema_found"]) for r in latest_schema(topics, versions).collect()}
    assert got == {"t": (3, "a:long, b:int", True), "u": (None, None, False)}


def test_conformance(spark):
    df = spark.createDataFrame([("1", "x"), (None, "2"), ("3", None)], "a string, b string")
    schema = {"a": ("int", True), "b": ("int", False)}
    assert [r["violations"] for r in conform(df, schema).collect()] == [["b:type"], ["a:missing"], []]
    assert [tuple(r) for r in conformance(df, schema).collect()] == [("a", 1, 0), ("b", 0, 1)]


@pytest.fixture(scope="module")
def runs(spark):
    data = [
        (1, 10, "START", "j1", ["a"], ["old"]),
        (1, 20, "COMPLETE", "j1", ["a"], ["old"]),
        (2, 30, "START", "j1", ["a"], ["b"]),
        (2, 40, "COMPLETE", "j1", ["a"], ["b"]),
        (3, 30, "START", "j2", ["b", "x"], ["c", "a"]),
        (3, 35, "COMPLETE", "j2", ["b", "x"], ["c", "a"]),
        (4, 50, "START", "j3", ["c"], ["d"]),
    ]
    df = spark.createDataFrame(
        data, "run_id long, s long, event_type string, job string, inputs array<string>, outputs array<string>"
    )
    return df.withColumn("event_time", F.timestamp_seconds("s").cast("timestamp_ntz"))


def test_edges_come_from_the_latest_completed_run(runs):
    got = {(r["source"], r["target"]) for r in lineage_edges(runs).collect()}
    assert got == {("a", "j1"), ("j1", "b"), ("b", "j2"), ("x", "j2"), ("j2", "c"), ("j2", "a")}


def test_closure_tolerates_cycles(spark, runs):
    edges = lineage_edges(runs)
    down = {tuple(r) for r in lineage_closure(spark, edges, "a").collect()}
    assert down == {("b", 1), ("c", 2)}
    up = {tuple(r) for r in lineage_closure(spark, edges, "c", "upstream").collect()}
    assert up == {("b", 1), ("x", 1), ("a", 2)}
    assert lineage_closure(spark, edges, "nowhere").count() == 0
    with pytest.raises(ValueError):
        lineage_closure(spark, edges, "a", "sideways")


def test_job_status(runs):
    got = {r["job"]: (r["status"], r["completed_runs"], r["total_seconds"]) for r in job_status(runs).collect()}
    assert got == {"j1": ("COMPLETE", 2, 20), "j2": ("COMPLETE", 1, 5), "j3": ("START", 0, None)}
