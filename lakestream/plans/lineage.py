"""Lineage of jobs whose runs are the orders: one job per customer, one run per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.operators.lineage import job_status, lineage_closure, lineage_edges, lineage_impact
from lakestream.plans.registry import query
from lakestream.session import load


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A START per order and, unless the order is pending, a COMPLETE some minutes later.

    Job ``c`` reads datasets ``c`` and ``c / 3`` and writes ``2c + 1`` and ``2c + 2``; every fiftieth also
    writes ``c / 50``, which closes cycles.
    """
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")

    def dataset(number):
        return F.concat(F.lit("ds_"), F.floor(number).cast("bigint").cast("string"))

    c = F.col("o_custkey")
    outputs = F.array(dataset(c * 2 + 1), dataset(c * 2 + 2))
    begun = F.struct(F.lit("START").alias("event_type"), F.col("o_orderdate").alias("event_time"))
    ended = F.struct(
        F.lit("COMPLETE").alias("event_type"),
        F.timestamp_add("MINUTE", F.col("o_orderkey") % 100, F.col("o_orderdate")).alias("event_time"),
    )
    events = F.when(F.col("o_orderstatus") == "P", F.array(begun)).otherwise(F.array(begun, ended))
    return orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("job_"), c.cast("string")).alias("job"),
        F.array(dataset(c), dataset(c / 3)).alias("inputs"),
        F.when(c % 50 == 0, F.concat(outputs, F.array(dataset(c / 50)))).otherwise(outputs).alias("outputs"),
        F.inline(events),
    )


EVENTS_SQL = """run_events AS (
  SELECT o_orderkey AS run_id, 'job_' || o_custkey AS job, o_custkey AS c, 'START' AS event_type, o_orderdate AS event_time FROM orders
  UNION ALL SELECT o_orderkey, 'job_' || o_custkey, o_custkey, 'COMPLETE', o_orderdate + to_minutes(CAST(o_orderkey % 100 AS INT)) FROM orders WHERE o_orderstatus <> 'P'),
done AS (SELECT * FROM run_events WHERE event_type = 'COMPLETE' QUALIFY row_number() OVER (PARTITION BY job ORDER BY event_time DESC, run_id DESC) = 1),
edges AS (
  SELECT DISTINCT * FROM (
    SELECT 'ds_' || c AS source, job AS target, 'reads' AS kind FROM done
    UNION ALL SELECT 'ds_' || (c // 3), job, 'reads' FROM done
    UNION ALL SELECT job, 'ds_' || (2 * c + 1), 'writes' FROM done
    UNION ALL SELECT job, 'ds_' || (2 * c + 2), 'writes' FROM done
    UNION ALL SELECT job, 'ds_' || (c // 50), 'writes' FROM done WHERE c % 50 = 0)),
hops AS (SELECT DISTINCT r.source AS a, w.target AS b FROM edges r JOIN edges w ON r.kind = 'reads' AND w.kind = 'writes' AND r.target = w.source)"""


@query("lineage_edges", f"WITH {EVENTS_SQL} SELECT source, target, kind FROM edges")
def lineage_edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage_edges(run_events(spark, sf_dir))


def _closure(direction: str, start: str, here: str, there: str):
    @query(
        f"lineage_{direction}",
        f"""WITH RECURSIVE {EVENTS_SQL},
        reach(node, d) USING KEY (node) AS (SELECT '{start}', 0 UNION SELECT h.{there}, min(r.d) + 1 FROM reach r JOIN hops h ON h.{here} = r.node
          WHERE h.{there} NOT IN (SELECT node FROM recurring.reach) GROUP BY 1)
        SELECT node AS dataset, d::INT AS distance FROM reach WHERE d > 0""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lineage_closure(spark, lineage_edges(run_events(spark, sf_dir)), start, direction)


_closure("downstream", "ds_5", "a", "b")
_closure("upstream", "ds_100", "b", "a")


@query(
    "lineage_impact",
    f"""WITH RECURSIVE {EVENTS_SQL}, starts AS (SELECT DISTINCT 'ds_' || o_custkey AS node FROM orders WHERE o_custkey % 20 = 0),
      reach(origin, node) AS (SELECT node, node FROM starts UNION SELECT origin, b FROM reach JOIN hops ON a = node)
      SELECT origin AS node, count(*) - 1 AS datasets FROM reach GROUP BY 1""",
)
def lineage_impact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many datasets depend on each twentieth customer's dataset, all counted in one pass over the edges per hop."""
    chosen = load(spark, sf_dir, "orders").filter("o_custkey % 20 = 0")
    starts = chosen.select(F.concat(F.lit("ds_"), F.col("o_custkey").cast("string")).alias("node"))
    return lineage_impact(spark, lineage_edges(run_events(spark, sf_dir)), starts)


@query(
    "job_status",
    f"""WITH {EVENTS_SQL}, runs AS (SELECT job, run_id,
        epoch(max(event_time) FILTER (WHERE event_type = 'COMPLETE')) - epoch(min(event_time) FILTER (WHERE event_type = 'START')) AS seconds FROM run_events GROUP BY 1, 2),
      last AS (SELECT job, event_type AS status FROM run_events
        QUALIFY row_number() OVER (PARTITION BY job ORDER BY event_time DESC, run_id DESC, event_type <> 'START' DESC) = 1)
      SELECT job, status, completed_runs, total_seconds FROM last JOIN
        (SELECT job, count(seconds) AS completed_runs, CAST(sum(seconds) AS BIGINT) AS total_seconds FROM runs GROUP BY 1) USING (job)""",
)
def job_status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_status(run_events(spark, sf_dir))
