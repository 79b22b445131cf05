from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestream.operators.records import unwrap, unwrap_and_route
from lakestream.functions.udf import Ngrams, digit_sum, geometric_mean
from lakestream.sources.cdc import cdc_feed, decode_json, filter_tables, kafka_source, read_snapshot, subscribe
from lakestream.sources.stream import check_rate

ROW = "struct<id: bigint, name: string>"
SCHEMA = (
    f"key bigint, topic string, value struct<before: {ROW}, after: {ROW}, op: string,"
    " source: struct<ts_ms: bigint, schema: string, table: string>, ts_ms: bigint>"
)


@pytest.fixture(scope="module")
def feed(spark):
    def source(t):
        return (t, "public", "csytab")

    return spark.createDataFrame(
        [
            (1, "m3-cdc.public.csytab", (None, (1, "a"), "c", source(10), 10)),
            (1, "m3-cdc.public.csytab", ((1, "a"), (1, "b"), "u", source(20), 20)),
            (1, "m3-cdc.public.csytab", ((1, "b"), None, "d", source(30), 30)),
            (1, "m3-cdc.public.csytab", None),
        ],
        SCHEMA,
    )


def test_rewrite_keeps_the_before_image_of_a_delete(feed):
    got = [tuple(r) for r in unwrap(feed, "rewrite").collect()]
    topic = "m3-cdc.public.csytab"
    assert got == [
        (1, topic, 1, "a", "c", 10, "false"),
        (1, topic, 1, "b", "u", 20, "false"),
        (1, topic, 1, "b", "d", 30, "true"),
    ]


def test_unknown_mode_is_rewrite(feed):
    assert unwrap(feed, "other").columns == unwrap(feed, "rewrite").columns


def test_drop_and_none(feed):
    assert [r["__op"] for r in unwrap(feed, "drop").collect()] == ["c", "u"]
    assert [r["name"] for r in unwrap(feed, "none").collect()] == ["a", "b", None]


def test_tombstones_can_stay(feed):
    kept = unwrap(feed, "rewrite", tombstones="keep").collect()
    assert len(kept) == 4 and kept[3]["__deleted"] is None


def test_headers(feed):
    first = unwrap(feed, headers=True).first()
    assert [tuple(h) for h in first["headers"]] == [("__op", "c"), ("__source_ts_ms", "10")]


def test_route_follows_unwrap(feed):
    out = unwrap_and_route(feed, "m3-cdc.public.(.*)", "bronze.m3.$1", delete_mode="drop")
    assert {r["topic"] for r in out.collect()} == {"bronze.m3.csytab"}


@pytest.mark.parametrize(
    "mode, has_offset, reads",
    [
        ("always", True, 1),
        ("initial", False, 1),
        ("initial", True, 0),
        ("never", False, 0),
        ("schema_only", False, 0),
        ("when_needed", True, 0),
        ("when_needed", False, 1),
        ("unheard of", False, 1),
    ],
)
def test_snapshot_modes(spark, feed, mode, has_offset, reads):
    snapshot = spark.createDataFrame(
        [(7, "m3-cdc.public.csytab", "public", "csytab", (7, "s"))],
        f"key bigint, topic string, source_schema string, source_table string, row {ROW}",
    )
    out = cdc_feed(snapshot, feed, mode, has_offset)
    assert out.schema["value"].dataType == feed.schema["value"].dataType
    assert out.filter("value.op = 'r'").count() == reads
    assert out.count() == 4 + reads


def test_table_filter(spark):
    df = spark.createDataFrame([("public.CSYTAB",), ("public.cidmas",), ("other.csytab",)], "t string")
    assert filter_tables(df, F.col("t"), include=["public.csytab", " public.CID.* "]).count() == 2
    assert filter_tables(df, F.col("t"), exclude=["public.*"]).count() == 1
    with pytest.raises(ValueError):
        filter_tables(df, F.col("t"), include=[])


def test_the_last_subscription_setting_wins(spark):
    df = spark.createDataFrame([("debug.silver.m3.a",), ("debugXsilver.m3.a",)], "topic string")
    assert subscribe(df, pattern=r"debug\.silver\..*").count() == 1
    assert subscribe(df, topics=["debugXsilver.m3.a"], pattern="debug.*").count() == 2
    assert subscribe(df, pattern="debug.*", topics=["debugXsilver.m3.a"]).count() == 1
    with pytest.raises(ValueError):
        subscribe(df)
    with pytest.raises(ValueError):
        kafka_source(spark, "host:1")
    with pytest.raises(TypeError):
        subscribe(df, names=["a"])


def test_decode(spark):
    schema = T.StructType([T.StructField("k", T.LongType())])
    df = spark.createDataFrame([('{"k": 1}',), ('{"k": ',), ("",)], "value string")
    got = [tuple(r) for r in decode_json(df, schema).collect()]
    assert got[0] == (1, None) and got[1][1] == '{"k": '
    wrapped = spark.createDataFrame([('{"schema": {}, "payload": {"k": 5}}',)], "value string")
    assert tuple(decode_json(wrapped, schema, envelope=True).first()) == (5, None)


def test_limits_are_validated(spark):
    check_rate(1, 1, 0)
    for bad in ({"batch_rows": 0}, {"queue_rows": 0}, {"poll_ms": -1}):
        with pytest.raises(ValueError):
            check_rate(**bad)
    with pytest.raises(ValueError):
        read_snapshot(spark, "jdbc:x", "t", "id", 0, 1, 0)


def test_records_without_an_operation_are_kept(spark):
    row = "struct<id: int>"
    schema = f"topic string, value struct<before: {row}, after: {row}, op: string, source: struct<ts_ms: bigint>>"
    feed = spark.createDataFrame([("t", (None, (1,), None, None)), ("t", ((2,), None, "d", None))], schema)
    for mode, ids in (("drop", [1]), ("rewrite", [1, 2]), ("none", [None, 1])):
        assert sorted((r["id"] for r in unwrap(feed, mode).collect()), key=str) == sorted(ids, key=str)


def test_patterns_match_whole_topics(spark):
    df = spark.createDataFrame([("a.b",), ("a.bc",), ("xa.b",)], "topic string")
    assert [r["topic"] for r in subscribe(df, pattern=r"a\.b").collect()] == ["a.b"]


def test_user_functions_on_nulls(spark):
    smallest = -(1 << 63)
    df = spark.createDataFrame([("a", 4.0, 1209), ("a", None, None), (None, 2.0, smallest), ("b", None, 0), (None, 8.0, -5)], "k string, v double, n long")
    got = {r["n"]: r["d"] for r in df.select("n", digit_sum("n").alias("d")).collect()}
    assert got == {1209: 12, None: None, smallest: sum(map(int, str(1 << 63))), 0: 0, -5: 5}
    means = {r["k"]: r["geo_mean"] for r in geometric_mean(df, "k", "v").collect()}
    assert means["a"] == pytest.approx(4) and means[None] == pytest.approx(4) and means["b"] is None
    texts = spark.createDataFrame([("u", "a b c"), ("u", None), (None, "x y")], "role string, text string")
    grams = {tuple(r) for r in Ngrams(texts.asTable(), F.lit(2)).collect()}
    assert grams == {("u", "a b"), ("u", "b c"), (None, "x y")}
