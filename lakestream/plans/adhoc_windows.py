"""Ad-hoc SQL over the tables: window functions, sorting, top-k, funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakestream.operators.ordered import (
    micros,
    null_safe_join,
    number_rows,
    over_positions,
    packed,
    ranked,
    sums_between,
)
from lakestream.operators.temporal import sessionize
from lakestream.plans.fixtures import HOLES_SQL, holey_events, holey_orders
from lakestream.plans.registry import query
from lakestream.session import load


def numbered_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events with their position ``rn`` in the user's history, counted chunk by chunk."""
    ev = holey_events(spark, sf_dir).select("user_id", "event_id", "ts", *columns)
    order = [F.col("ts").asc_nulls_last(), F.col("event_id")]
    chunks = packed(ev, ["user_id"], micros(F.col("ts")), "event_id")
    return number_rows(chunks, ["user_id"], "_chunk", order).drop("_chunk")


@query(
    "win_rank",
    f"""WITH {HOLES_SQL} SELECT o_orderpriority, o_orderkey, o_totalprice, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank,
      cume_dist() OVER w AS cume_dist, row_number() OVER t AS row_number, CAST(ntile(7) OVER t AS INT) AS ntile
      FROM o WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC), t AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)""",
)
def win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.floor(F.col("o_totalprice") / 1000).cast("long")
    return ranked(holey_orders(spark, sf_dir), ["o_orderpriority"], "o_totalprice", band, "o_orderkey", tiles=7)


@query(
    "win_lag",
    f"""WITH {HOLES_SQL} SELECT user_id, event_id, lag(value) OVER w AS previous, lead(value) OVER w AS next, first_value(value) OVER w AS first,
      last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
      nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def win_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered_events(spark, sf_dir, "value")
    near = over_positions(
        rows, ["user_id"], "rn", {"previous": (F.min("value"), -1, -1), "next": (F.min("value"), 1, 1)}
    )
    # fixed-width values, so this is a hash aggregate with one partial row per user and task
    ends = rows.groupBy("user_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("first"),
        F.max(F.when(F.col("rn") == 2, F.col("value"))).alias("second"),
        F.max_by("value", "rn").alias("last"),
    )
    joined = null_safe_join(near, ends, ["user_id"])
    return joined.select("user_id", "event_id", "previous", "next", "first", "last", "second")


@query(
    "win_moving_avg",
    f"""WITH {HOLES_SQL} SELECT user_id, event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(*) OVER w AS moving_avg
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def win_moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered_events(spark, sf_dir, "value").withColumn("amount", F.col("value").cast("decimal(18,2)"))
    framed = over_positions(
        rows, ["user_id"], "rn", {"total": (F.sum("amount"), -2, 0), "n": (F.count("*"), -2, 0)}
    )
    return framed.select("user_id", "event_id", (F.col("total").cast("double") / F.col("n")).alias("moving_avg"))


@query(
    "win_range",
    f"""WITH {HOLES_SQL} SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS trailing
      FROM e""",
)
def win_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the user in the hour up to each event; events without a time are peers of each other."""
    hour = 3600 * 1_000_000
    rows = holey_events(spark, sf_dir).select("user_id", "event_id", micros(F.col("ts")).alias("at"))
    timed, untimed = rows.filter("at IS NOT NULL"), rows.filter("at IS NULL")
    framed = sums_between(timed, timed, ["user_id"], "at", -hour, 0, {"trailing": F.lit(1)})
    peers = untimed.groupBy("user_id").agg(F.count("*").alias("trailing"))
    return framed.unionByName(null_safe_join(untimed, peers, ["user_id"])).drop("at")


@query(
    "sort_limit",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10",
)
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25)


@query(
    "topk_per_group",
    """SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3""",
)
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter on the row number becomes a group limit before the shuffle: three rows per group and task."""
    best = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    customers = load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return customers.withColumn("rn", F.row_number().over(best)).filter("rn <= 3").drop("rn")


@query(
    "funnel",
    f"""WITH {HOLES_SQL} SELECT user_id, count(*) AS funnels, min(event_id) AS first_view FROM (
        SELECT user_id, event_id, event_type, lead(event_type) OVER w AS second, lead(event_type, 2) OVER w AS third
        FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      WHERE event_type = 'view' AND second = 'click' AND third = 'purchase' GROUP BY 1""",
)
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered_events(spark, sf_dir, "event_type")
    steps = over_positions(
        rows, ["user_id"], "rn", {"second": (F.min("event_type"), 1, 1), "third": (F.min("event_type"), 2, 2)}
    )
    found = steps.filter("event_type = 'view' AND second = 'click' AND third = 'purchase'")
    return found.groupBy("user_id").agg(F.count("*").alias("funnels"), F.min("event_id").alias("first_view"))


@query(
    "session_window",
    f"""WITH {HOLES_SQL}, gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM gaps)
      SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = holey_events(spark, sf_dir).select("user_id", "event_id", "ts")
    return sessionize(ev, ["user_id"], "ts", "event_id", 1800, {"n": F.lit(1)})
