from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakestream.functions import naming

# Expected parts: (environment, layer, domain, subdomain, dataset, stage, error)
PARSED = {
    "bronze.m3.csytab": (None, "bronze", "m3", None, "csytab", None, None),
    "dev.silver.m3.orders": ("dev", "silver", "m3", None, "orders", None, None),
    "debug.silver.m3.order_summary": ("debug", "silver", "m3", None, "order_summary", None, None),
    "silver.m3.s1.s2.orders_cleaned": (None, "silver", "m3", "s1.s2", "orders", "cleaned", None),
    "silver.m3.a_b_RAW": (None, "silver", "m3", None, "a_b", "RAW", None),
    "silver.m3._raw": (None, "silver", "m3", None, "_raw", None, None),
    "bronze.silver.m3.x": (None, "bronze", "silver", "m3", "x", None, None),
    "Gold.m3.kpi": (None, "gold", "m3", None, "kpi", None, None),
    "silver..orders": (None, "silver", "", None, "orders", None, None),
    "silver.m3": (None,) * 6 + ("too few parts",),
    "dev.silver.m3": (None,) * 6 + ("no layer",),
    "x.y.z": (None,) * 6 + ("no layer",),
    "a.b.silver.m3.q": (None,) * 6 + ("no layer",),
    "": (None,) * 6 + ("empty topic",),
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(t,) for t in PARSED], "topic string")
    return naming.with_topic_parts(df)


def test_parse(parsed):
    got = {r["topic"]: tuple(r)[1:] for r in parsed.collect()}
    assert got == PARSED


def test_build_is_the_inverse_of_parse(parsed):
    c = F.col
    built = naming.topic_name(c("layer"), c("domain"), c("dataset"), c("environment"), c("subdomain"), c("stage"))
    for row in parsed.withColumn("built", built).collect():
        if row["parse_error"]:
            assert row["built"] is None
        else:
            assert row["built"] == row["topic"].replace("Gold", "gold")


def test_table_and_dead_letter_names(spark):
    df = naming.with_topic_parts(spark.createDataFrame([("bronze.m3.csytab",)], "topic string"))
    row = df.select(
        naming.lake_table(F.col("layer"), F.col("domain"), F.col("dataset"), F.col("stage")).alias("table"),
        naming.dlq_topic(F.col("topic")).alias("dlq"),
        naming.dlq_topic(F.col("topic"), "own").alias("own"),
        naming.dlq_topic(F.col("topic"), naming.DEFAULT_DLQ).alias("derived"),
        naming.dlq_topic(None).alias("default"),
        naming.value_subject(F.col("topic")).alias("subject"),
        naming.layer_compatibility(F.col("layer")).alias("level"),
        naming.layer_compatibility(F.lit("platinum")).alias("other"),
    ).first()
    assert tuple(row) == (
        "bronze.m3_csytab",
        "bronze.m3.csytab_dlq",
        "own",
        "bronze.m3.csytab_dlq",
        "m3.iceberg.dlq",
        "bronze.m3.csytab-value",
        "NONE",
        "BACKWARD",
    )


def test_tables_collide_across_environments(spark):
    topics = ["dev.silver.m3.a.orders", "silver.m3.b.orders"]
    df = naming.with_topic_parts(spark.createDataFrame([(t,) for t in topics], "topic string"))
    table = naming.lake_table(F.col("layer"), F.col("domain"), F.col("dataset"))
    assert {r[0] for r in df.select(table).collect()} == {"silver.m3_orders"}


def test_output_topics(spark):
    tables = ["public.CSYTAB", "public.CIDMAS", "public.CIDVEN"]
    df = spark.createDataFrame([(t,) for t in tables], "name string")
    topic = naming.output_topic(F.col("name"), "m3-cdc", F.lit("Postgres"), "m3-cdc.public.(.*)", "bronze.m3.$1")
    assert [r[0] for r in df.select(topic).collect()] == ["bronze.m3.csytab", "bronze.m3.cidmas", "bronze.m3.cidven"]


def test_route_needs_the_whole_name(spark):
    names = ["m3-cdc.public.a", "x.m3-cdc.public.a", "m3-cdcXpublicYa"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = [r[0] for r in df.select(naming.route_topic(F.col("t"), "m3-cdc.public.(.*)", "bronze.m3.$1")).collect()]
    assert got == ["bronze.m3.a", "x.m3-cdc.public.a", "bronze.m3.a"]


def test_resolution_and_prefix(spark):
    row = spark.range(1).select(
        naming.resolve_table(F.lit(""), F.lit("b"), F.lit("c")).alias("parts"),
        naming.resolve_table(F.lit("a"), F.lit("b"), F.lit("c")).alias("explicit"),
        naming.resolve_table(F.lit(None), F.lit(None), F.lit("c")).alias("topic"),
        naming.topic_prefix(F.lit("Bronze"), F.lit("m3"), F.lit("sub")).alias("prefix"),
    ).first()
    assert tuple(row) == ("b", "a", "c", "bronze.m3.sub")
