"""Silver layer: summaries, the maintained join, script and code jobs, keyed state, restarts, stream joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.plans.registry import query
from lakestream.session import load, stream_session, work_dir
from lakestream.sources.lake import read_log, read_upserted
from lakestream.sources.stream import stage_files, stream_source
from lakestream.streaming.jobs import RESTART_MODES, checkpoint_for, run_code_job, run_sql_job, run_sql_stream
from lakestream.streaming.joins import keyed_join, stream_join
from lakestream.streaming.sink import append_to, run_available, upsert_to


#: Files of the batch that comes before all others.
FIRST_FILES = 2


def _price():
    return F.col("o_totalprice").cast("decimal(18,2)")


_SUMMARY_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS record_key, 'silver.order_summary' AS iceberg_table, count(*) AS order_count,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
  FROM orders GROUP BY o_custkey"""

_CUSTOMERS_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS record_key, 'silver.customers' AS iceberg_table, c_name, c_mktsegment, c_nationkey FROM customer"""


def summary(orders: DataFrame) -> DataFrame:
    """Orders per customer. Grouping comes first, so a busy customer is reduced before any shuffle."""
    return orders.groupBy("o_custkey").agg(
        F.count("*").alias("order_count"),
        F.sum(_price()).cast("decimal(28,2)").alias("total_price"),
        F.min("o_orderdate").alias("first_date"),
        F.max("o_orderdate").alias("last_date"),
    )


@query("order_summary", _SUMMARY_SQL)
def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(load(spark, sf_dir, "orders")).select(
        F.col("o_custkey").cast("string").alias("record_key"),
        F.lit("silver.order_summary").alias("iceberg_table"),
        "order_count",
        F.col("total_price").cast("double").alias("total_price"),
        "first_date",
        "last_date",
    )


@query("silver_customers", _CUSTOMERS_SQL)
def silver_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("record_key"),
        F.lit("silver.customers").alias("iceberg_table"),
        "c_name",
        "c_mktsegment",
        "c_nationkey",
    )


ANALYTICS_SQL = f"""SELECT s.record_key, c_name, c_mktsegment, order_count, total_price, first_date, last_date
  FROM ({_SUMMARY_SQL}) s JOIN ({_CUSTOMERS_SQL}) c ON s.record_key = c.record_key"""
# the same with some orders and customers that have no key, which meet nothing
HOLEY_ANALYTICS_SQL = """WITH some_orders AS (SELECT * REPLACE (CASE WHEN o_orderkey % 89 <> 0 THEN o_custkey END AS o_custkey) FROM orders),
some_customers AS (SELECT * REPLACE (CASE WHEN c_custkey % 97 <> 0 THEN c_custkey END AS c_custkey) FROM customer) """ + (
    ANALYTICS_SQL.replace("FROM orders", "FROM some_orders").replace("FROM customer", "FROM some_customers")
)


@query("customer_order_analytics", ANALYTICS_SQL)
def customer_order_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = order_summary(spark, sf_dir).drop("iceberg_table").join(
        silver_customers(spark, sf_dir).drop("iceberg_table", "c_nationkey"), "record_key"
    )
    return joined.select(
        "record_key", "c_name", "c_mktsegment", "order_count", "total_price", "first_date", "last_date"
    )


@query("customer_order_analytics_stream", HOLEY_ANALYTICS_SQL)
def customer_order_analytics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, first alone and then mixed with customers, arrive in micro-batches; their join is one aggregate per customer."""
    base = work_dir(spark, "analytics")
    orders = load(spark, sf_dir, "orders").withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 89 <> 0 THEN o_custkey END"))
    customer = load(spark, sf_dir, "customer").withColumn(
        "o_custkey", F.expr("CASE WHEN c_custkey % 97 <> 0 THEN c_custkey END")
    )
    order_rows = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    first, later = order_rows.filter("o_orderkey % 4 = 0"), order_rows.filter("o_orderkey % 4 <> 0")
    people = customer.select("o_custkey", "c_custkey", "c_name", "c_mktsegment")
    changes = later.unionByName(people, allowMissingColumns=True)
    place = F.xxhash64("o_custkey", "o_orderkey")
    stage_files(first.withColumn("place", place), f"{base}/in", "place", files=FIRST_FILES)
    changes = changes.withColumn("place", place)
    stage_files(changes, f"{base}/in", "place")
    stream = stream_source(stream_session(spark), f"{base}/in", changes.schema)
    person = F.when(F.col("c_custkey").isNotNull(), F.struct("c_name", "c_mktsegment"))
    sides = {
        # null until the first order: a sum without rows
        "order_count": F.sum(F.when(F.col("o_orderkey").isNotNull(), 1)),
        "total_price": F.sum(_price()).cast("decimal(28,2)"),
        "first_date": F.min("o_orderdate"),
        "last_date": F.max("o_orderdate"),
        "person": F.max_by(person, "c_custkey"),
    }
    joined = keyed_join(stream, ["o_custkey"], sides, ["order_count", "person"])
    # counts only grow, and of equal ones the later commit holds
    place = (["o_custkey"], ["order_count"])
    run_available(joined, upsert_to(f"{base}/analytics", *place), f"{base}/checkpoint", mode="update")
    result = read_upserted(spark, f"{base}/analytics", *place)
    return result.select(
        F.col("o_custkey").cast("string").alias("record_key"),
        "person.c_name",
        "person.c_mktsegment",
        "order_count",
        F.col("total_price").cast("double").alias("total_price"),
        "first_date",
        "last_date",
    )


_SCRIPT = """
-- orders of one priority; comments and quoted ';' do not end a statement
CREATE OR REPLACE TEMPORARY VIEW urgent AS
  SELECT *, 'a;b' AS note FROM orders WHERE o_orderpriority = '1-URGENT';
SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top_price
FROM urgent GROUP BY o_orderstatus, o_orderpriority;
"""
_SCRIPT_SQL = """SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(max(o_totalprice) AS DOUBLE) AS top_price FROM orders
      WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2"""


@query("sql_script_job", _SCRIPT_SQL)
def sql_script_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = """
    BEGIN
      CREATE OR REPLACE TEMPORARY VIEW urgent AS SELECT * FROM orders WHERE o_orderpriority = wanted_priority;
      CREATE OR REPLACE TEMPORARY VIEW by_status AS
        SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top_price
        FROM urgent GROUP BY o_orderstatus, o_orderpriority;
      SELECT * FROM by_status;
    END
    """
    tables = {"orders": lambda session: load(session, sf_dir, "orders")}
    return run_sql_job(spark, block, {"wanted_priority": "1-URGENT"}, tables)


@query("sql_script_plain", _SCRIPT_SQL)
def sql_script_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql_job(spark, _SCRIPT, tables={"orders": lambda session: load(session, sf_dir, "orders")})


@query("sql_script_stream", _SCRIPT_SQL)
def sql_script_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same script over a topic: its counts are upserted into a silver table batch by batch."""
    base = work_dir(spark, "sql_stream")
    orders = load(spark, sf_dir, "orders")
    stage_files(orders, f"{base}/orders", "o_orderkey")
    topics = {"orders": lambda session: stream_source(session, f"{base}/orders", orders.schema)}
    keys = ["o_orderstatus", "o_orderpriority"]
    run_sql_stream(spark, _SCRIPT, topics, upsert_to(f"{base}/silver", keys, ["n"]), f"{base}/checkpoint", mode="update")
    return read_upserted(spark, f"{base}/silver", keys, ["n"])


def orders_by_status(session: SparkSession, params: dict[str, str]) -> DataFrame:
    """Entry point of the code job."""
    orders = load(session, params["path"], "orders").filter(F.col("o_orderstatus") == params["status"])
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("code_job", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def code_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_code_job(spark, "lakestream.plans.silver:orders_by_status", {"path": sf_dir, "status": "F"})


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")


@query("stateful_count", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def stateful_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running count per user, stopped after half of the events and resumed from its checkpoint."""
    base = work_dir(spark, "stateful")
    session = stream_session(spark)
    for half in _halves(spark, sf_dir):
        stage_files(half, f"{base}/in", "event_id")
        counts = stream_source(session, f"{base}/in", half.schema).groupBy("user_id").agg(F.count("*").alias("n"))
        run_available(counts, upsert_to(f"{base}/table", ["user_id"], ["n"]), f"{base}/checkpoint", mode="update")
    return read_upserted(spark, f"{base}/table", ["user_id"], ["n"])


def _restarted(mode: str):
    seen = "event_id % 2 = 1" if mode != "stateless" else "true"

    @query(
        f"restart_{mode.replace('-', '_')}",
        f"SELECT '{mode}' AS mode, event_type, count(*) AS n FROM events WHERE {seen} GROUP BY 1, 2",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Events the second run of a job processes, by restart mode."""
        base = work_dir(spark, "restart")
        session = stream_session(spark)
        checkpoint = f"{base}/checkpoint"
        for number, half in enumerate(_halves(spark, sf_dir)):
            stage_files(half, f"{base}/in", "event_id")
            if number == 1:
                checkpoint = checkpoint_for(spark, mode, checkpoint, f"{base}/fresh", f"{base}/checkpoint")
            stream = stream_source(session, f"{base}/in", half.schema)
            run_available(stream, append_to(f"{base}/run{number}"), checkpoint)
        rows = read_log(spark, f"{base}/run1").groupBy("event_type").agg(F.count("*").alias("n"))
        return rows.select(F.lit(mode).alias("mode"), "event_type", "n")


for _mode in RESTART_MODES:
    _restarted(_mode)


@query(
    "stream_join_ack",
    """SELECT event_id, user_id, ts, ts + to_minutes(CAST(event_id % 90 AS INT)) AS ack_ts FROM events WHERE event_id % 90 <= 60""",
)
def stream_join_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only join of two streams: events with an acknowledgement within an hour."""
    base = work_dir(spark, "ack")
    session = stream_session(spark)
    zoned = F.col("ts").cast("timestamp")
    events = load(spark, sf_dir, "events").select("event_id", "user_id", zoned.alias("ts"))
    acks = events.select("event_id", F.timestamp_add("MINUTE", F.col("event_id") % 90, F.col("ts")).alias("ack_ts"))
    stage_files(events, f"{base}/events", "event_id")
    stage_files(acks, f"{base}/acks", "event_id")
    joined = stream_join(
        stream_source(session, f"{base}/events", events.schema),
        stream_source(session, f"{base}/acks", acks.schema),
        ["event_id"],
        "ts",
        "ack_ts",
        # replayed files come in no order of time, so nothing counts as late
        late="40 days",
        within="1 hour",
    )
    run_available(joined, append_to(f"{base}/out"), f"{base}/checkpoint")
    out = read_log(spark, f"{base}/out").drop("commit")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "ack_ts")})


@query(
    "stream_join_left",
    """SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 AND event_id % 90 <= 60 THEN ts + to_minutes(CAST(event_id % 90 AS INT)) END AS ack_ts FROM events""",
)
def stream_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, with its acknowledgement if one came within an hour; a third is never answered, others too late."""
    base, session = work_dir(spark, "ack-left"), stream_session(spark)
    events = load(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    acks = events.filter("event_id % 3 <> 0").select(
        "event_id", F.timestamp_add("MINUTE", F.col("event_id") % 90, F.col("ts")).alias("ack_ts")
    )
    # the feeds go on: a row of each, long after, moves both watermarks past all others
    later = F.max("ts") + F.expr("interval 200 days")
    end = events.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), later.alias("ts"))
    stage_files(events, f"{base}/events", "event_id")
    stage_files(acks, f"{base}/acks", "event_id")
    joined = lambda: stream_join(
        stream_source(session, f"{base}/events", events.schema),
        stream_source(session, f"{base}/acks", acks.schema),
        ["event_id"],
        "ts",
        "ack_ts",
        late="40 days",
        within="1 hour",
        how="left",
    )
    run_available(joined(), append_to(f"{base}/out"), f"{base}/checkpoint")
    stage_files(end, f"{base}/events", "event_id", files=1)
    stage_files(end.select(F.lit(-2).cast("long").alias("event_id"), F.col("ts").alias("ack_ts")), f"{base}/acks", "event_id", files=1)
    run_available(joined(), append_to(f"{base}/out"), f"{base}/checkpoint")
    out = read_log(spark, f"{base}/out").filter("event_id >= 0").drop("commit")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "ack_ts")})
