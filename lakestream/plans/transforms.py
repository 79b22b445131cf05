"""Record transforms, and the flow from change events to a bronze table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.functions.naming import lake_table, with_topic_parts
from lakestream.operators.latest import current_rows, latest_per_key
from lakestream.operators.records import drop_tombstones, meta_headers, unwrap, unwrap_and_route
from lakestream.plans.fixtures import CDC_SQL, ROUTE_REGEX, ROUTE_REPLACEMENT, cdc_events, with_tombstones
from lakestream.plans.registry import query
from lakestream.functions.naming import route_topic

_META = "op AS __op, ts_ms AS __source_ts_ms"


@query(
    "unwrap_rewrite",
    f"""WITH {CDC_SQL} SELECT key, "offset", topic, user_id, event_type, value, {_META},
      CASE WHEN op = 'd' THEN 'true' ELSE 'false' END AS __deleted FROM cdc""",
)
def unwrap_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwrap(with_tombstones(cdc_events(spark, sf_dir)), "rewrite")


@query(
    "unwrap_drop",
    f"""WITH {CDC_SQL} SELECT key, "offset", topic, user_id, event_type, value, {_META} FROM cdc WHERE op <> 'd'""",
)
def unwrap_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwrap(with_tombstones(cdc_events(spark, sf_dir)), "drop")


@query(
    "unwrap_none",
    f"""WITH {CDC_SQL} SELECT key, "offset", topic, CASE WHEN op <> 'd' THEN user_id END AS user_id,
      CASE WHEN op <> 'd' THEN event_type END AS event_type, CASE WHEN op <> 'd' THEN value END AS value, {_META} FROM cdc""",
)
def unwrap_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwrap(with_tombstones(cdc_events(spark, sf_dir)), "none")


@query(
    "drop_tombstones",
    f"""WITH {CDC_SQL} SELECT op, count(*) AS n, CAST(sum("offset") AS BIGINT) AS offsets FROM cdc GROUP BY op""",
)
def drop_tombstones_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_tombstones(with_tombstones(cdc_events(spark, sf_dir)))
    return kept.groupBy(F.col("value.op").alias("op")).agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"))


@query(
    "unwrap_headers",
    f"""WITH {CDC_SQL} SELECT "offset",
      '[{{"key":"__op","value":"' || op || '"}},{{"key":"__source_ts_ms","value":"' || ts_ms || '"}}]' AS headers FROM cdc""",
)
def unwrap_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = drop_tombstones(cdc_events(spark, sf_dir))
    return feed.select("offset", F.to_json(meta_headers()).alias("headers"))


@query(
    "route_topic",
    f"""WITH {CDC_SQL}, named AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'x.' ELSE '' END || topic AS topic FROM cdc)
      SELECT topic, regexp_replace(topic, '^(?:m3-cdc.public.(.*))$', 'bronze.m3.\\1') AS routed, count(*) AS n FROM named GROUP BY 1, 2""",
)
def route_topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = cdc_events(spark, sf_dir)
    topic = F.concat(F.when(F.col("offset") % 8 == 0, "x.").otherwise(""), F.col("topic"))
    return (
        feed.select(topic.alias("topic"))
        .groupBy("topic")
        .agg(F.count("*").alias("n"))
        .withColumn("routed", route_topic(F.col("topic"), ROUTE_REGEX, ROUTE_REPLACEMENT))
    )


BRONZE_FLOW_SQL = f"""WITH {CDC_SQL}, latest AS (
  SELECT * FROM cdc QUALIFY row_number() OVER (PARTITION BY tbl, key ORDER BY "offset" DESC) = 1)
SELECT 'bronze.m3_' || tbl AS lake_table, 'bronze.m3.' || tbl AS topic, user_id, event_type, value, "offset", {_META},
  'false' AS __deleted FROM latest WHERE op <> 'd'"""


@query("bronze_flow", BRONZE_FLOW_SQL)
def bronze_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events to the visible rows of the bronze tables: unwrap, route, name, upsert, hide deletes."""
    feed = with_tombstones(cdc_events(spark, sf_dir))
    records = unwrap_and_route(feed, ROUTE_REGEX, ROUTE_REPLACEMENT)
    # one row per key survives the upsert, so names are built after it
    rows = current_rows(latest_per_key(records, ["topic", "user_id"], ["offset"]))
    parts = with_topic_parts(rows)
    table = lake_table(F.col("layer"), F.col("domain"), F.col("dataset"), F.col("stage"))
    return parts.select(table.alias("lake_table"), *[c for c in rows.columns if c != "key"])
