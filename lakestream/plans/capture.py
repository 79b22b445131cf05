"""Sources: change feeds, table filters, subscriptions, decoding, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestream.functions.naming import normalize_table
from lakestream.plans.fixtures import (
    CAPTURED_TABLES,
    CDC_SQL,
    SOURCE_TABLES,
    TOPIC_PREFIX,
    cdc_events,
    pick,
)
from lakestream.plans.registry import query
from lakestream.session import load, stream_session, work_dir
from lakestream.sources.cdc import cdc_feed, decode_json, filter_tables, subscribe
from lakestream.sources.lake import append, read_log, read_upserted
from lakestream.sources.stream import stage_files, stream_source
from lakestream.streaming.sink import run_available, upsert_to

SNAPSHOT_SQL = """snap AS (
  SELECT c_custkey AS key, -1 AS "offset", 'm3-cdc.public.csytab' AS topic, 'r' AS op, 0 AS ts_ms,
    c_custkey AS user_id, c_mktsegment AS event_type, c_acctbal AS value FROM customer),
changes AS (
  SELECT key, "offset", topic, op, ts_ms,
    CASE WHEN op <> 'd' THEN user_id END AS user_id, CASE WHEN op <> 'd' THEN event_type END AS event_type,
    CASE WHEN op <> 'd' THEN value END AS value FROM cdc)"""


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type"), F.col("c_acctbal").alias("value")
    )
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"),
        F.lit(-1).cast("long").alias("offset"),
        F.lit(f"{TOPIC_PREFIX}.public.csytab").alias("topic"),
        F.lit("public").alias("source_schema"),
        F.lit("csytab").alias("source_table"),
        row.alias("row"),
    )


def _feed(mode: str, first: str, restarted: str):
    """The feed of a first start, and of a start that finds a stored position."""
    parts = " UNION ALL ".join(
        f"SELECT {state} AS has_offset, * FROM {s}"
        for state, sources in (("false", first), ("true", restarted))
        for s in sources.split()
    )

    @query(f"cdc_feed_{mode}", f"WITH {CDC_SQL}, {SNAPSHOT_SQL} {parts}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def start(has_offset: bool) -> DataFrame:
            feed = cdc_feed(_snapshot(spark, sf_dir), cdc_events(spark, sf_dir), mode, has_offset)
            state = F.lit(has_offset).alias("has_offset")
            return feed.select(state, "key", "offset", "topic", "value.op", "value.ts_ms", "value.after.*")

        return start(False).unionByName(start(True))


_feed("always", "snap changes", "snap changes")
_feed("initial", "snap changes", "changes")
_feed("never", "changes", "changes")
_feed("schema_only", "changes", "changes")
_feed("when_needed", "snap changes", "changes")


@query(
    "table_filter",
    f"""WITH {CDC_SQL} SELECT tbl, count(*) AS n FROM cdc
    WHERE regexp_matches('public.' || tbl, '(?i)^(public.CSYTAB|public.CID.*)$')
      AND NOT regexp_matches('public.' || tbl, '(?i)^(public.CIDVEN)$') GROUP BY tbl""",
)
def table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = cdc_events(spark, sf_dir)
    name = F.concat_ws(".", "value.source.schema", "value.source.table")
    kept = filter_tables(feed, name, include=["public.CSYTAB", "public.CID.*"], exclude=["public.CIDVEN"])
    return kept.groupBy(F.col("value.source.table").alias("tbl")).agg(F.count("*").alias("n"))


KINDS = ("Postgres", "MySQL", "Db2", "Db2as400", "Oracle", "SqlServer", "MongoDB")


@query(
    "case_normalize",
    """WITH t AS (SELECT event_id,
        list_extract(['CSYTAB','CIDMAS','CIDVEN','ORDERS','ITEMS','AUDIT'], CAST(event_id % 6 + 1 AS INT)) AS a,
        list_extract(['Postgres','MySQL','Db2','Db2as400','Oracle','SqlServer','MongoDB'], CAST(event_id % 7 + 1 AS INT)) AS kind FROM events),
      n AS (SELECT event_id, kind, 'Public.' || a AS name FROM t)
      SELECT kind, CASE WHEN kind IN ('Postgres','MySQL') THEN lower(name) WHEN kind IN ('Db2','Db2as400','Oracle') THEN upper(name) ELSE name END AS normalized,
        count(*) AS n FROM n GROUP BY 1, 2""",
)
def case_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    named = ev.select(
        F.concat(F.lit("Public."), pick(SOURCE_TABLES, F.col("event_id"))).alias("name"),
        pick(KINDS, F.col("event_id")).alias("kind"),
    )
    return named.groupBy("kind", normalize_table(F.col("name"), F.col("kind")).alias("normalized")).agg(
        F.count("*").alias("n")
    )


_LAYERED = """layered AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'debug.silver.' WHEN event_id % 3 = 1 THEN 'debugXsilver.' ELSE 'bronze.' END || 'm3.' || event_type AS topic FROM events)"""


def _layered_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    prefix = pick(("debug.silver.", "debugXsilver.", "bronze."), F.col("event_id"))
    return ev.select("event_id", F.concat(prefix, F.lit("m3."), "event_type").alias("topic"))


@query(
    "subscribe_list",
    f"WITH {_LAYERED} SELECT topic, count(*) AS n FROM layered WHERE topic IN ('bronze.m3.click', 'debug.silver.m3.view') GROUP BY topic",
)
def subscribe_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = subscribe(_layered_topics(spark, sf_dir), topics=["bronze.m3.click", "debug.silver.m3.view"])
    return chosen.groupBy("topic").agg(F.count("*").alias("n"))


@query(
    "subscribe_pattern",
    rf"WITH {_LAYERED} SELECT topic, count(*) AS n FROM layered WHERE regexp_matches(topic, '^debug\.silver\..*') GROUP BY topic",
)
def subscribe_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = subscribe(_layered_topics(spark, sf_dir), pattern=r"debug\.silver\..*")
    return chosen.groupBy("topic").agg(F.count("*").alias("n"))


_PROPS = T.StructType([T.StructField("k", T.LongType())])


@query(
    "decode_json",
    """SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
      CASE WHEN event_id % 97 = 0 THEN substring(props, 1, length(props) - 1) END AS _corrupt_record FROM events""",
)
def decode_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 97 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    records = load(spark, sf_dir, "events").select("event_id", text.alias("value"))
    return decode_json(records, _PROPS).withColumn("k", F.when(F.col("_corrupt_record").isNull(), F.col("k")))


@query(
    "decode_json_envelope",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS _corrupt_record FROM events",
)
def decode_json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit('{"schema":{"type":"struct"},"payload":'), "props", F.lit("}"))
    records = load(spark, sf_dir, "events").select("event_id", wrapped.alias("value"))
    return decode_json(records, _PROPS, envelope=True)


@query("scan_prune", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def scan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "scan_prune")
    append(load(spark, sf_dir, "events"), path, 0, partition_by="event_type")
    return read_log(spark, path).filter("event_type = 'purchase'").select("event_id", "user_id", "value")


@query(
    "stream_rate_limited",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
def stream_rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark, "rate")
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    stage_files(events, f"{base}/in", "event_id")
    stream = stream_source(stream_session(spark), f"{base}/in", events.schema)
    run_available(stream, upsert_to(f"{base}/table", ["user_id"], ["event_id"]), f"{base}/checkpoint")
    return read_upserted(spark, f"{base}/table", ["user_id"], ["event_id"])
