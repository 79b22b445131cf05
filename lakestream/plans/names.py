"""Topic and table naming, and routing to target tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.functions.naming import (
    dlq_topic,
    lake_table,
    layer_compatibility,
    output_topic,
    resolve_table,
    topic_name,
    topic_prefix,
    with_topic_parts,
)
from lakestream.operators.routing import fan_out, route_by_field
from lakestream.plans.fixtures import (
    DAMAGED_SQL,
    ROUTE_REGEX,
    ROUTE_REPLACEMENT,
    SOURCE_TABLES,
    TOPIC_PREFIX,
    TOPICS_SQL,
    damaged_events,
    pick,
    topic_names,
)
from lakestream.plans.registry import query
from lakestream.session import load


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_topic_parts(topic_names(spark, sf_dir))


def _rebuilt():
    c = F.col
    return topic_name(c("layer"), c("domain"), c("dataset"), c("environment"), c("subdomain"), c("stage"))


def _table():
    return lake_table(F.col("layer"), F.col("domain"), F.col("dataset"), F.col("stage"))


@query(
    "topic_parse",
    f"WITH {TOPICS_SQL} SELECT event_id, topic, environment, layer, domain, subdomain, dataset, stage, parse_error FROM parsed",
)
def topic_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).drop("user_id", "event_type")


@query("topic_stage", f"WITH {TOPICS_SQL} SELECT stage, count(*) AS n, count(DISTINCT dataset) AS datasets FROM parsed GROUP BY stage")
def topic_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct("dataset").alias("datasets"))


@query(
    "topic_roundtrip",
    f"""WITH {TOPICS_SQL} SELECT event_id, topic, rebuilt, rebuilt = topic AS same FROM named WHERE rebuilt IS NOT NULL""",
)
def topic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = _parsed(spark, sf_dir).filter("parse_error IS NULL").withColumn("rebuilt", _rebuilt())
    return rebuilt.select("event_id", "topic", "rebuilt", (F.col("rebuilt") == F.col("topic")).alias("same"))


@query("topic_to_table", f"WITH {TOPICS_SQL} SELECT topic, lake_table, count(*) AS n FROM named GROUP BY 1, 2")
def topic_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    # names repeat, so they are counted before they are parsed
    topics = topic_names(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("n"))
    return with_topic_parts(topics).select("topic", _table().alias("lake_table"), "n")


@query(
    "table_collisions",
    f"""WITH {TOPICS_SQL} SELECT lake_table, count(DISTINCT topic) AS topics FROM named WHERE lake_table IS NOT NULL
      GROUP BY lake_table HAVING count(DISTINCT topic) > 1""",
)
def table_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = topic_names(spark, sf_dir).select("topic").distinct()
    return (
        with_topic_parts(topics)
        .filter("parse_error IS NULL")
        .withColumn("lake_table", _table())
        .groupBy("lake_table")
        .agg(F.count("*").alias("topics"))
        .filter("topics > 1")
    )


@query(
    "dlq_name",
    f"""WITH {TOPICS_SQL}, e AS (SELECT event_id, topic,
        CASE event_id % 3 WHEN 0 THEN 'm3-cdc-errors' WHEN 1 THEN 'm3.iceberg.dlq' ELSE '' END AS explicit FROM topics)
      SELECT event_id, coalesce(nullif(nullif(explicit, ''), 'm3.iceberg.dlq'), nullif(topic, '') || '_dlq', 'm3.iceberg.dlq') AS dlq FROM e""",
)
def dlq_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = topic_names(spark, sf_dir)
    # An explicit dead-letter name and the default one.
    explicit = pick(("m3-cdc-errors", "m3.iceberg.dlq", ""), F.col("event_id"))
    return names.select("event_id", dlq_topic(F.col("topic"), explicit).alias("dlq"))


@query(
    "layer_compat",
    f"""WITH {TOPICS_SQL} SELECT layer, CASE layer WHEN 'bronze' THEN 'NONE' WHEN 'silver' THEN 'BACKWARD' WHEN 'gold' THEN 'FULL' END AS level,
      count(*) AS n FROM parsed GROUP BY 1, 2""",
)
def layer_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = _parsed(spark, sf_dir).groupBy("layer").agg(F.count("*").alias("n"))
    return layers.withColumn("level", layer_compatibility(F.col("layer")))


@query(
    "output_topics",
    """WITH t AS (SELECT event_id,
        'public.' || list_extract(['CSYTAB','CIDMAS','CIDVEN','ORDERS','ITEMS','AUDIT'], CAST(event_id % 6 + 1 AS INT)) AS name,
        CASE event_id % 4 WHEN 0 THEN 'postgres' WHEN 1 THEN 'oracle' WHEN 2 THEN 'sqlserver' ELSE 'mysql' END AS kind,
        CASE WHEN event_id % 5 = 0 THEN 'bronze.m3' ELSE 'm3-cdc' END AS prefix FROM events),
      n AS (SELECT kind, name, prefix || '.' || CASE WHEN kind IN ('postgres', 'mysql') THEN lower(name) WHEN kind = 'oracle' THEN upper(name) ELSE name END AS topic FROM t)
      SELECT kind, name, regexp_replace(topic, '^(?:m3-cdc.public.(.*))$', 'bronze.m3.\\1') AS topic, count(*) AS n FROM n GROUP BY 1, 2, 3""",
)
def output_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    explicit = F.when(F.col("event_id") % 5 != 0, TOPIC_PREFIX)
    tables = ev.select(
        F.concat(F.lit("public."), pick(SOURCE_TABLES, F.col("event_id"))).alias("name"),
        pick(("postgres", "oracle", "sqlserver", "mysql"), F.col("event_id")).alias("kind"),
        topic_prefix(F.lit("Bronze"), F.lit("m3"), explicit=explicit).alias("prefix"),
    )
    counted = tables.groupBy("kind", "name", "prefix").agg(F.count("*").alias("n"))
    topic = output_topic(F.col("name"), F.col("prefix"), F.col("kind"), ROUTE_REGEX, ROUTE_REPLACEMENT)
    return counted.groupBy("kind", "name", topic.alias("topic")).agg(F.sum("n").alias("n"))


@query(
    "dynamic_route",
    f"""WITH {DAMAGED_SQL} SELECT lower(iceberg_table) AS target, count(*) AS n FROM damaged GROUP BY 1""",
)
def dynamic_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route_by_field(damaged_events(spark, sf_dir), "iceberg_table")
    return routed.groupBy("target").agg(F.count("*").alias("n"))


@query(
    "static_fanout",
    """SELECT target, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
      FROM (SELECT *, unnest(['bronze.m3_events', 'bronze.m3_audit']) AS target FROM events) GROUP BY 1, 2""",
)
def static_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = fan_out(load(spark, sf_dir, "events"), ["bronze.m3_events", "Bronze.m3_audit"])
    return copies.groupBy("target", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "resolve_table",
    f"""WITH {TOPICS_SQL} SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN 'silver.fixed' WHEN event_id % 5 = 1 THEN NULL END,
      CASE WHEN event_id % 2 = 0 THEN 'silver.m3_' || event_type || '_raw' END, lake_table) AS lake_table FROM named""",
)
def resolve_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    explicit = F.when(F.col("event_id") % 5 == 0, "silver.fixed").when(F.col("event_id") % 5 == 1, "")
    parts = F.when(
        F.col("event_id") % 2 == 0, lake_table(F.lit("Silver"), F.lit("m3"), F.col("event_type"), F.lit("raw"))
    )
    return _parsed(spark, sf_dir).select("event_id", resolve_table(explicit, parts, _table()).alias("lake_table"))
