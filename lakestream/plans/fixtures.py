"""Deterministic feeds derived from the given tables, each with the same rule in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.operators.ordered import micros
from lakestream.session import load

# Captured tables, topic prefix and route in use.
CAPTURED_TABLES = ("CSYTAB", "CIDMAS", "CIDVEN")
OTHER_TABLES = ("ORDERS", "ITEMS", "AUDIT")
TOPIC_PREFIX = "m3-cdc"
ROUTE_REGEX = "m3-cdc.public.(.*)"
ROUTE_REPLACEMENT = "bronze.m3.$1"

SOURCE_TABLES = CAPTURED_TABLES + OTHER_TABLES


def epoch_ms(ts: Column) -> Column:
    return F.floor(micros(ts) / F.lit(1000)).cast("long")


def operation() -> Column:
    return (
        F.when(F.col("event_type") == "signup", "c")
        .when(F.col("event_type") == "view", "r")
        .when(F.col("event_type") == "error", "d")
        .otherwise("u")
    )


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def table_of_event() -> Column:
    return pick(SOURCE_TABLES, F.col("event_id"))


def cdc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change envelopes: one per event, keyed by user; every sixth table name in turn."""
    ev = load(spark, sf_dir, "events")
    op = operation()
    ts_ms = epoch_ms(F.col("ts"))
    row = F.struct("user_id", "event_type", "value")
    value = F.struct(
        F.when(op.isin("u", "d"), row).alias("before"),
        F.when(op != "d", row).alias("after"),
        op.alias("op"),
        F.struct(
            ts_ms.alias("ts_ms"), F.lit("public").alias("schema"), F.lower(table_of_event()).alias("table")
        ).alias("source"),
        ts_ms.alias("ts_ms"),
    )
    return ev.select(
        F.col("user_id").alias("key"),
        (F.col("event_id") * 2).alias("offset"),
        F.concat(F.lit(f"{TOPIC_PREFIX}.public."), F.lower(table_of_event())).alias("topic"),
        value.alias("value"),
    )


def with_tombstones(feed: DataFrame) -> DataFrame:
    """One null-valued record after each delete."""
    kind = feed.schema["value"].dataType
    is_delete = F.coalesce(F.col("value.op") == "d", F.lit(False))
    records = F.when(is_delete, F.array(F.struct("offset", "value"), F.struct(
        (F.col("offset") + 1).alias("offset"), F.lit(None).cast(kind).alias("value")
    ))).otherwise(F.array(F.struct("offset", "value")))
    return feed.withColumn("_record", F.explode(records)).select(
        "key", F.col("_record.offset").alias("offset"), "topic", F.col("_record.value").alias("value")
    )


CDC_SQL = """cdc AS (
  SELECT user_id AS key, 2 * event_id AS "offset", event_id, user_id, event_type, value,
    CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
    epoch_us(ts) // 1000 AS ts_ms,
    lower(list_extract(['CSYTAB','CIDMAS','CIDVEN','ORDERS','ITEMS','AUDIT'], CAST(event_id % 6 + 1 AS INT))) AS tbl,
    'm3-cdc.public.' || lower(list_extract(['CSYTAB','CIDMAS','CIDVEN','ORDERS','ITEMS','AUDIT'], CAST(event_id % 6 + 1 AS INT))) AS topic
  FROM events)"""


def bronze_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flat bronze records with an offset and the soft-delete flag."""
    return load(spark, sf_dir, "events").select(
        "user_id",
        "event_type",
        "value",
        F.col("event_id").alias("offset"),
        F.when(F.col("event_type") == "error", "true").otherwise("false").alias("__deleted"),
    )


BRONZE_SQL = """bronze AS (
  SELECT user_id, event_type, value, event_id AS "offset",
    CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END AS __deleted
  FROM events)"""


def damaged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw text records: some JSON cut short, some values not numeric, some without a route."""
    ev = load(spark, sf_dir, "events")
    return ev.select(
        F.lit("bronze.m3.events").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        "user_id",
        F.when(F.col("event_id") % 97 == 0, F.expr("substring(props, 1, length(props) - 1)"))
        .otherwise(F.col("props"))
        .alias("raw_value"),
        F.when(F.col("event_id") % 101 == 0, "x")
        .otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
        .alias("amount"),
        F.when(F.col("event_id") % 103 != 0, F.concat(F.lit("Silver."), F.col("event_type"))).alias("iceberg_table"),
    )


DAMAGED_SQL = """damaged AS (
  SELECT 'bronze.m3.events' AS topic, 0 AS "partition", event_id AS "offset", event_id, user_id, event_type,
    CASE WHEN event_id % 97 = 0 THEN substring(props, 1, length(props) - 1) ELSE props END AS raw_value,
    CASE WHEN event_id % 101 = 0 THEN 'x' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
    CASE WHEN event_id % 103 <> 0 THEN 'Silver.' || event_type END AS iceberg_table
  FROM events)"""

# Valid and invalid topic names, filled with the event's type and user.
TOPIC_TEMPLATES = (
    "bronze.m3.{t}",
    "dev.silver.m3.{t}_u{u}",
    "silver.m3.s1.s2.{t}_cleaned",
    "silver.m3.{t}_{u}_RAW",
    "silver.m3._raw",
    "bronze.silver.m3.{t}",
    "Gold.m3.{t}_aggregated",
    "silver..{t}",
    "silver.m{u}",
    "dev.silver.m3",
    "{t}.y.u{u}",
    "a.b.silver.m3.{t}",
    "test.GOLD.m3.sub.{t}_Enriched",
    "prod.bronze.m3.{t}",
    "bronze.m3.sub.{t}",
    "",
)


def topic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic name per event, templates in turn."""
    ev = load(spark, sf_dir, "events")
    name = pick(TOPIC_TEMPLATES, F.col("event_id"))
    name = F.replace(F.replace(name, F.lit("{t}"), F.col("event_type")), F.lit("{u}"), F.col("user_id").cast("string"))
    return ev.select("event_id", "user_id", "event_type", name.alias("topic"))


_TEMPLATE_LIST = ", ".join(f"'{t}'" for t in TOPIC_TEMPLATES)
TOPICS_SQL = f"""topics AS (
  SELECT event_id, user_id, event_type,
    replace(replace(list_extract([{_TEMPLATE_LIST}], CAST(event_id % {len(TOPIC_TEMPLATES)} + 1 AS INT)), '{{t}}', event_type),
      '{{u}}', CAST(user_id AS VARCHAR)) AS topic
  FROM events),
split AS (SELECT *, string_split(topic, '.') AS p FROM topics),
placed AS (
  SELECT *, CASE WHEN lower(p[1]) IN ('bronze','silver','gold') THEN 1
    WHEN len(p) >= 4 AND lower(p[2]) IN ('bronze','silver','gold') THEN 2 END AS pos
  FROM split),
parsed AS (
  SELECT event_id, user_id, event_type, topic,
    CASE WHEN trim(topic) = '' THEN 'empty topic' WHEN len(p) < 3 THEN 'too few parts' WHEN pos IS NULL THEN 'no layer' END AS parse_error,
    CASE WHEN len(p) >= 3 AND pos = 2 THEN p[1] END AS environment,
    CASE WHEN len(p) >= 3 THEN lower(p[pos]) END AS layer,
    CASE WHEN len(p) >= 3 THEN p[pos + 1] END AS domain,
    CASE WHEN len(p) >= 3 AND len(p) - pos > 2 THEN array_to_string(p[pos + 2:len(p) - 1], '.') END AS subdomain,
    CASE WHEN len(p) >= 3 AND pos IS NOT NULL THEN
      CASE WHEN regexp_matches(p[len(p)], '(?i)^(.+)_(raw|cleaned|enriched|denormalized|aggregated)$')
        THEN regexp_extract(p[len(p)], '(?i)^(.+)_(raw|cleaned|enriched|denormalized|aggregated)$', 1) ELSE p[len(p)] END END AS dataset,
    CASE WHEN len(p) >= 3 AND pos IS NOT NULL THEN
      nullif(regexp_extract(p[len(p)], '(?i)^(.+)_(raw|cleaned|enriched|denormalized|aggregated)$', 2), '') END AS stage
  FROM placed),
named AS (
  SELECT *, CASE WHEN layer IS NOT NULL THEN concat_ws('.', environment, layer, domain, subdomain, concat_ws('_', dataset, stage)) END AS rebuilt,
    CASE WHEN layer IS NOT NULL THEN layer || '.' || concat_ws('_', domain, dataset, stage) END AS lake_table
  FROM parsed)"""


# Events and orders with holes: some keys, times and values are null, by rule of the id.
HOLES_SQL = """e AS (SELECT event_id, CASE WHEN event_id % 89 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 97 <> 0 THEN ts END AS ts,
  event_type, CASE WHEN event_id % 83 <> 0 THEN value END AS value FROM events),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 89 <> 0 THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 83 <> 0 THEN o_totalprice END AS o_totalprice FROM orders)"""


def holey_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.when(F.col("event_id") % 89 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("ts"),
        "event_type",
        F.when(F.col("event_id") % 83 != 0, F.col("value")).alias("value"),
    )


def holey_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 89 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_orderkey") % 83 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )
