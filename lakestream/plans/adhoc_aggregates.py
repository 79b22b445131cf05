"""Ad-hoc SQL over the tables: aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.operators.ordered import quantile_positions
from lakestream.plans.fixtures import HOLES_SQL, holey_orders
from lakestream.plans.registry import query
from lakestream.session import load


def _total(name: str):
    return F.sum(F.col(name).cast("decimal(18,2)")).cast("double")


def _total_sql(name: str) -> str:
    return f"CAST(sum(CAST({name} AS DECIMAL(18,2))) AS DOUBLE)"


@query(
    "agg_pricing_summary",
    f"""SELECT l_returnflag, l_linestatus, {_total_sql('l_quantity')} AS sum_qty, {_total_sql('l_extendedprice')} AS sum_base_price,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_disc_price,
      {_total_sql('l_quantity')} / count(*) AS avg_qty, {_total_sql('l_extendedprice')} / count(*) AS avg_price, count(*) AS n
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""",
)
def agg_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    price, discount = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        _total("l_quantity").alias("sum_qty"),
        _total("l_extendedprice").alias("sum_base_price"),
        F.sum(price * (1 - discount)).cast("double").alias("sum_disc_price"),
        (_total("l_quantity") / F.count("*")).alias("avg_qty"),
        (_total("l_extendedprice") / F.count("*")).alias("avg_price"),
        F.count("*").alias("n"),
    )


@query(
    "agg_distinct",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY 1""",
)
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_partkey").alias("parts"),
        F.countDistinct("l_suppkey").alias("suppliers"),
        F.count("*").alias("n"),
    )


@query(
    "agg_approx",
    "SELECT l_returnflag, count(*) AS n, true AS parts_within, true AS quartiles_within FROM lineitem GROUP BY 1",
)
def agg_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates per group, held against the exact values: within five standard errors, and ranks within the accuracy."""
    lines = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_extendedprice")
    error, accuracy, fractions = 0.02, 10_000, [0.25, 0.5, 0.75]
    estimates = lines.groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        F.approx_count_distinct("l_partkey", error).alias("parts"),
        F.percentile_approx("l_extendedprice", fractions, accuracy).alias("quartiles"),
    )
    exact = lines.groupBy("l_returnflag", "l_partkey").count().groupBy("l_returnflag").agg(F.count("*").alias("exact"))
    at = [F.element_at("quartiles", i + 1) for i in range(3)]
    # a value at rank r has at most r rows below it and at least r up to it
    ranks = [(F.count_if(F.col("l_extendedprice") < v), F.count_if(F.col("l_extendedprice") <= v)) for v in at]
    within = [
        (below <= F.lit(f + 1 / accuracy) * F.count("*") + 1) & (upto >= F.lit(f - 1 / accuracy) * F.count("*") - 1)
        for f, (below, upto) in zip(fractions, ranks, strict=True)
    ]
    ranked = lines.join(estimates, "l_returnflag").groupBy("l_returnflag").agg(
        (within[0] & within[1] & within[2]).alias("quartiles_within")
    )
    close = F.abs(F.col("parts") - F.col("exact")) <= 5 * error * F.col("exact") + 1
    joined = estimates.join(exact, "l_returnflag").join(ranked, "l_returnflag")
    return joined.select("l_returnflag", "n", close.alias("parts_within"), "quartiles_within")


@query(
    "agg_rollup",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {_total_sql('l_quantity')} AS quantity, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level
      FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), _total("l_quantity").alias("quantity"), F.grouping_id().alias("level")
    )


@query(
    "agg_cube",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level
      FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
)
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.grouping_id().alias("level")
    )


@query(
    "agg_grouping_sets",
    """SELECT p_brand, p_type, count(*) AS n, max(p_size) AS top_size FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_type), ())""",
)
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    sets = [[F.col("p_brand"), F.col("p_type")], [F.col("p_type")], []]
    return part.groupingSets(sets, "p_brand", "p_type").agg(
        F.count("*").alias("n"), F.max("p_size").alias("top_size")
    )


@query(
    "agg_filter",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS clicks,
      max(CASE WHEN event_type = 'purchase' THEN value END) AS top_purchase FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') >= 10""",
)
def agg_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        load(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.count_if(kind == "error").alias("errors"),
            F.count_if(kind == "click").alias("clicks"),
            F.max(F.when(kind == "purchase", F.col("value"))).alias("top_purchase"),
        )
        .filter("errors >= 10")
    )


@query(
    "agg_percentile",
    f"""WITH {HOLES_SQL} SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90
      FROM o GROUP BY 1""",
)
def agg_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.floor(F.col("o_totalprice") / 1000).cast("long")
    exact = quantile_positions(
        holey_orders(spark, sf_dir), ["o_orderpriority"], "o_totalprice", band, [0.25, 0.5, 0.9]
    )
    # prices have two decimals, so four hold every interpolated value
    return exact.select("o_orderpriority", *[F.round(p, 4).alias(p) for p in ("p25", "p50", "p90")])


@query(
    "agg_pivot",
    """SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1""",
)
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return pivoted.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query(
    "agg_extremes",
    """SELECT event_type, max_by(event_id, (value, event_id)) AS top_event, min_by(event_id, (value, event_id)) AS low_event,
      list_sort(list(DISTINCT user_id % 5)) AS shards FROM events GROUP BY 1""",
)
def agg_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("value", "event_id")
    return load(spark, sf_dir, "events").groupBy("event_type").agg(
        F.max_by("event_id", at).alias("top_event"),
        F.min_by("event_id", at).alias("low_event"),
        # a set of at most five values
        F.sort_array(F.collect_set(F.col("user_id") % 5)).alias("shards"),
    )
