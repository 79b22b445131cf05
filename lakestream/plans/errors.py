"""Dead letters, fail-fast, metrics, fingerprints and table drift."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.functions.hashing import changed_rows, fingerprint
from lakestream.functions.metrics import relabel
from lakestream.functions.naming import dlq_topic
from lakestream.operators.errors import (
    Check,
    fail_fast,
    retry,
    sink_metrics,
    split_errors,
    tag_errors,
    worker_counts,
)
from lakestream.operators.routing import route_by_field
from lakestream.plans.fixtures import DAMAGED_SQL, damaged_events, pick
from lakestream.plans.registry import query
from lakestream.session import load, stream_session, work_dir
from lakestream.sources.lake import append, read_log
from lakestream.sources.stream import stage_files, stream_source
from lakestream.streaming.sink import append_to, run_available, split_to

RAW = ("topic", "partition", "offset", "raw_value")


def checks() -> list[Check]:
    return [
        Check("decode", "InvalidJson", "value is not JSON", F.try_parse_json("raw_value").isNull()),
        Check("cast", "InvalidNumber", "amount is not a number", F.col("amount").try_cast("decimal(18,2)").isNull()),
        Check("route", "MissingRoute", "iceberg_table is null", F.col("iceberg_table").isNull()),
    ]


_TAGGED = f"""{DAMAGED_SQL},
tagged AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'decode' WHEN event_id % 101 = 0 THEN 'cast' WHEN event_id % 103 = 0 THEN 'route' END AS error_stage FROM damaged)"""

_LETTERS = """SELECT topic, "partition", "offset", raw_value, 'events-sink' AS connector, topic || '_dlq' AS dlq_topic, error_stage,
    CASE error_stage WHEN 'decode' THEN 'InvalidJson' WHEN 'cast' THEN 'InvalidNumber' ELSE 'MissingRoute' END AS error_class,
    CASE error_stage WHEN 'decode' THEN 'value is not JSON' WHEN 'cast' THEN 'amount is not a number' ELSE 'iceberg_table is null' END AS error_message
  FROM tagged WHERE error_stage IS NOT NULL"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return split_errors(damaged_events(spark, sf_dir), checks(), "events-sink", RAW, dlq_topic(F.col("topic")))


@query("dlq_records", f"WITH {_TAGGED} {_LETTERS}")
def dlq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)[1]


@query(
    "dlq_good",
    f"""WITH {_TAGGED} SELECT topic, "partition", "offset", user_id, raw_value, amount, iceberg_table FROM tagged WHERE error_stage IS NULL""",
)
def dlq_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)[0]


@query("stream_dlq", f"WITH {_TAGGED} {_LETTERS}")
def stream_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same split while streaming: dead letters end up in their own table."""
    base = work_dir(spark, "stream_dlq")
    records = damaged_events(spark, sf_dir)
    stage_files(records, f"{base}/in", "offset")
    stream = stream_source(stream_session(spark), f"{base}/in", records.schema)
    commit = split_to(
        append_to(f"{base}/good"), f"{base}/dlq", checks(), "events-sink", RAW, dlq_topic(F.col("topic"))
    )
    run_available(stream, commit, f"{base}/checkpoint")
    return read_log(spark, f"{base}/dlq").drop("commit")


@query(
    "fail_fast_guard",
    f"""WITH {DAMAGED_SQL} SELECT count(*) FILTER (WHERE event_id % 97 = 0) > 0 AS stopped, 'InvalidJson' AS error_class FROM damaged""",
)
def fail_fast_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the guarded scan and reports the error that stopped it."""
    guarded = fail_fast(damaged_events(spark, sf_dir), checks()[:1])
    error_class = None
    try:
        guarded.agg(F.count("*")).collect()
    except PySparkException as error:
        found = [c.error_class for c in checks() if c.error_class in str(error)]
        error_class = found[0] if found else type(error).__name__
    return spark.range(1).select(
        F.lit(error_class is not None).alias("stopped"), F.lit(error_class).cast("string").alias("error_class")
    )


@query("retry_commit", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def retry_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch's first write fails half-way, after some files are there; the retried one is seen, once."""
    path = work_dir(spark, "retry")
    events = load(spark, sf_dir, "events").select("event_id", "event_type")
    for commit in range(2):
        batch, pending = events.filter(F.col("event_id") % 2 == commit), [ConnectionError("lost while writing")]

        def write(batch: DataFrame = batch, commit: int = commit, pending: list[Exception] = pending) -> None:
            if pending:
                batch.filter("event_id % 3 = 0").write.parquet(f"{path}/commit={commit}")
                raise pending.pop()
            append(batch, path, commit)

        retry(write, first_delay=0.01)
    return read_log(spark, path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "sink_metrics",
    f"""WITH {_TAGGED} SELECT 'sink-' || user_id % 5 AS connector, "offset" % 4 AS task,
      count(*) FILTER (WHERE error_stage IN ('decode', 'cast')) AS total_record_errors,
      count(*) FILTER (WHERE error_stage IN ('decode', 'cast')) AS deadletterqueue_produce_requests,
      count(*) FILTER (WHERE error_stage IS NULL) AS sink_record_send_total,
      count(*) FILTER (WHERE error_stage = 'route') AS unrouted_total,
      count(DISTINCT "offset" // 1000) AS offset_commit_completion_total
      FROM tagged GROUP BY 1, 2""",
)
def sink_metrics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tag_errors(damaged_events(spark, sf_dir), checks()[:2]).withColumns(
        {
            "connector": F.concat(F.lit("sink-"), (F.col("user_id") % 5).cast("string")),
            "task": F.col("offset") % 4,
            "commit": F.floor(F.col("offset") / 1000).cast("long"),
        }
    )
    return sink_metrics(route_by_field(tagged, "iceberg_table"), "connector", "task", "commit", "target")


@query(
    "worker_counts",
    """SELECT user_id % 10 AS worker, count(DISTINCT user_id) AS connector_count, count(DISTINCT (user_id, event_type)) AS task_count
      FROM events GROUP BY 1""",
)
def worker_counts_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = load(spark, sf_dir, "events").withColumn("worker", F.col("user_id") % 10)
    return worker_counts(running, "worker", "user_id", "event_type")


SAMPLE_TEMPLATES = (
    "kafka.connect<type=task-error-metrics, connector=Sink-{u}, task={t}><>total-record-errors",
    "kafka.connect<type=task-error-metrics, connector=Sink-{u}, task={t}><>deadletterqueue-produce-requests",
    "kafka.connect<type=connect-worker-metrics><>connector-count",
    "kafka.connect<type=connect-worker-metrics><>task-count",
    "kafka.connect<type=sink-task-metrics, connector=Sink-{u}, task={t}><>sink-record-send-total",
    "kafka.connect<type=sink-task-metrics, connector=Sink-{u}, task={t}><>offset-commit-completion-total",
    "kafka.connect<type=sink-task-metrics, connector=Sink-{u}, task={t}><>put-batch-avg-time-ms",
    "java.lang<type=Memory><>HeapMemoryUsage",
)
_SAMPLES = ", ".join(f"'{s}'" for s in SAMPLE_TEMPLATES)


@query(
    "metric_relabel",
    f"""WITH samples AS (SELECT event_id, replace(replace(list_extract([{_SAMPLES}], CAST(event_id % 8 + 1 AS INT)), '{{u}}', CAST(user_id AS VARCHAR)),
        '{{t}}', CAST(event_id % 10 AS VARCHAR)) AS name FROM events),
      m AS (SELECT *, regexp_extract(name, '<>(.*)$', 1) AS attr,
        nullif(regexp_extract(name, 'connector=(.+), task=', 1), '') AS connector, nullif(regexp_extract(name, 'task=(.+)><>', 1), '') AS task FROM samples)
      SELECT CASE WHEN attr IN ('total-record-errors', 'deadletterqueue-produce-requests') THEN 'kafka_connect_task_error_'
          WHEN attr IN ('connector-count', 'task-count') THEN 'kafka_connect_worker_' ELSE 'kafka_connect_sink_task_' END || replace(attr, '-', '_') AS metric,
        connector, task, CAST(sum(event_id) AS BIGINT) AS value
      FROM m WHERE attr IN ('total-record-errors', 'deadletterqueue-produce-requests', 'connector-count', 'task-count', 'sink-record-send-total', 'offset-commit-completion-total')
      GROUP BY 1, 2, 3""",
)
def metric_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace(pick(SAMPLE_TEMPLATES, F.col("event_id")), F.lit("{u}"), F.col("user_id").cast("string"))
    name = F.replace(name, F.lit("{t}"), (F.col("event_id") % 10).cast("string"))
    # samples of one name are added up before the regular expressions run
    samples = load(spark, sf_dir, "events").groupBy(name.alias("name")).agg(F.sum("event_id").alias("value"))
    return relabel(samples).select("metric", "connector", "task", "value")


def _money(name: str):
    return F.col(name).cast("decimal(18,2)")


PRINT_SQL = """substring(sha256(concat_ws(chr(31), coalesce(c_name, chr(30)), coalesce(CAST(c_nationkey AS VARCHAR), chr(30)),
    coalesce(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), chr(30)), coalesce(c_mktsegment, chr(30)))), 1, 16)"""


def customer_columns():
    return [F.col("c_name"), F.col("c_nationkey"), _money("c_acctbal"), F.col("c_mktsegment")]


@query("row_fingerprint", f"SELECT c_custkey, {PRINT_SQL} AS print FROM customer")
def row_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", fingerprint(customer_columns()).alias("print"))


EDITED_SQL = """edited AS (
  SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 50 = 1 THEN CAST(c_acctbal AS DECIMAL(18,2)) + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment
    FROM customer WHERE c_custkey % 50 <> 0
  UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 2)"""


def edited_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    raised = F.when(F.col("c_custkey") % 50 == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    copies = F.when(F.col("c_custkey") % 50 == 2, F.array(F.lit(0), F.lit(10_000_000))).otherwise(F.array(F.lit(0)))
    kept = customer.filter("c_custkey % 50 <> 0").withColumn("_shift", F.explode(copies))
    return kept.select(
        (F.col("c_custkey") + F.col("_shift")).alias("c_custkey"), "c_name", "c_nationkey", raised.alias("c_acctbal"),
        "c_mktsegment",
    )


@query(
    "snapshot_diff",
    f"""WITH {EDITED_SQL}, o AS (SELECT c_custkey, {PRINT_SQL} AS old_print FROM customer), n AS (SELECT c_custkey, {PRINT_SQL} AS new_print FROM edited)
      SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, old_print, new_print,
        CASE WHEN old_print IS NULL THEN 'added' WHEN new_print IS NULL THEN 'removed' WHEN old_print <> new_print THEN 'changed' ELSE 'same' END AS change
      FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "customer")
    return changed_rows(old, edited_customer(spark, sf_dir), ["c_custkey"], customer_columns())
