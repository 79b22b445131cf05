"""Ad-hoc SQL over the tables: filters, joins, set operations, subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.operators.temporal import asof_join, interval_join, range_join
from lakestream.plans.fixtures import HOLES_SQL, holey_events
from lakestream.plans.registry import query
from lakestream.session import load


def _money(name: str):
    return F.col(name).cast("decimal(18,2)")


def _revenue():
    return F.sum(_money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double")


_REVENUE_SQL = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)"


@query(
    "pricing_filter",
    """SELECT CASE WHEN l_quantity < 10 THEN 'small' ELSE 'medium' END AS size_class, l_returnflag, count(*) AS n,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue
      FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.03 AND 0.07
        AND l_quantity < 24 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%' GROUP BY 1, 2""",
)
def pricing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").filter(
        (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
        & F.col("l_discount").between(0.03, 0.07)
        & (F.col("l_quantity") < 24)
        & F.col("l_returnflag").isin("A", "R")
        & F.col("l_linestatus").like("F%")
    )
    size_class = F.when(F.col("l_quantity") < 10, "small").otherwise("medium")
    revenue = F.sum(_money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).cast("double")
    return lines.groupBy(size_class.alias("size_class"), "l_returnflag").agg(
        F.count("*").alias("n"), revenue.alias("revenue")
    )


@query(
    "join_inner",
    """SELECT o_orderpriority, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are added up per order before the join, so an order with very many lines joins as one row."""
    lines = (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count("*").alias("lines"), F.sum(_money("l_quantity")).alias("quantity"))
    )
    joined = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(
        F.sum("lines").alias("lines"), F.sum("quantity").cast("double").alias("quantity")
    )


@query(
    "join_star",
    f"""SELECT n_name, {_REVENUE_SQL} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
      JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1""",
)
def join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions narrow the facts first; each is broadcast only while its size allows."""
    nations = load(spark, sf_dir, "nation").join(
        load(spark, sf_dir, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = (
        load(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_nationkey", "n_name")
    )
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = (
        load(spark, sf_dir, "orders")
        .filter(
            (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
            & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
        )
        .select("o_orderkey", "o_custkey")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
    )
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        suppliers,
        (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")),
    )
    return joined.groupBy("n_name").agg(_revenue().alias("revenue"))


@query(
    "join_full",
    """SELECT coalesce(c.nation, s.nation) AS nation, customers, suppliers FROM
      (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c
      FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_acctbal < 1000 GROUP BY 1) s ON c.nation = s.nation""",
)
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = (
        load(spark, sf_dir, "customer")
        .filter("c_acctbal > 9000")
        .groupBy(F.col("c_nationkey").alias("nation"))
        .agg(F.count("*").alias("customers"))
    )
    suppliers = (
        load(spark, sf_dir, "supplier")
        .filter("s_acctbal < 1000")
        .groupBy(F.col("s_nationkey").alias("nation"))
        .agg(F.count("*").alias("suppliers"))
    )
    return customers.join(suppliers, "nation", "full")


@query(
    "join_left",
    """SELECT c_custkey, c_name, coalesce(n, 0) AS urgent FROM customer LEFT JOIN
      (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey""",
)
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = (
        load(spark, sf_dir, "orders")
        .filter("o_orderpriority = '1-URGENT'")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n"))
    )
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customers.join(urgent, "c_custkey", "left").select(
        "c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("urgent")
    )


@query(
    "join_semi",
    """SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
      AND l_shipdate > o_orderdate + INTERVAL 80 DAY) GROUP BY 1""",
)
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some line is late exactly when the last one is, so lines shrink to one row per order first."""
    last = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    late = (F.col("o_orderkey") == F.col("l_orderkey")) & (
        F.col("last_ship") > F.col("o_orderdate") + F.expr("interval 80 days")
    )
    orders = load(spark, sf_dir, "orders").join(last, late, "left_semi")
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "join_anti",
    """SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer
      WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY 1""",
)
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey").distinct()
    idle = load(spark, sf_dir, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.sum(_money("c_acctbal")).cast("double").alias("balance")
    )


@query(
    "join_range",
    """WITH bands AS (SELECT DISTINCT CAST(floor(sqrt(o_totalprice / 1000)) AS BIGINT) AS band FROM orders),
      ranges AS (SELECT band, band * band * 1000.0::DOUBLE AS low, (band + 1) * (band + 1) * 1000.0::DOUBLE AS high FROM bands)
      SELECT band, low, high, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN ranges ON o_totalprice >= low AND o_totalprice < high GROUP BY 1, 2, 3""",
)
def join_range_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    band = F.floor(F.sqrt(F.col("o_totalprice") / 1000)).cast("bigint")
    ranges = (
        orders.select(band.alias("band"))
        .distinct()
        .select(
            "band",
            (F.col("band") * F.col("band") * F.lit(1000.0)).alias("low"),
            ((F.col("band") + 1) * (F.col("band") + 1) * F.lit(1000.0)).alias("high"),
        )
    )
    placed = range_join(orders, ranges, "o_totalprice", "low", "high", width=10_000.0)
    return placed.groupBy("band", "low", "high").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@query(
    "join_asof",
    f"""WITH {HOLES_SQL} SELECT p.event_id, p.user_id, p.ts, c.click_id, c.click_value
      FROM (SELECT event_id, user_id, ts FROM e WHERE event_type = 'purchase') p
      ASOF LEFT JOIN (SELECT user_id, ts, event_id AS click_id, value AS click_value FROM e WHERE event_type = 'click') c
      ON p.user_id = c.user_id AND p.ts >= c.ts""",
)
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = holey_events(spark, sf_dir)
    purchases = ev.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    clicks = ev.filter("event_type = 'click'").select(
        "user_id", "ts", "event_id", F.col("event_id").alias("click_id"), F.col("value").alias("click_value")
    )
    return asof_join(purchases, clicks, ["user_id"], "ts", "event_id", ["click_id", "click_value"])


@query(
    "join_interval",
    f"""WITH {HOLES_SQL} SELECT c.event_id, c.user_id, count(p.event_id) AS purchases, min(epoch_us(p.ts)) AS first_purchase_us
      FROM (SELECT * FROM e WHERE event_type = 'click') c LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') p
      ON p.user_id = c.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR GROUP BY 1, 2""",
)
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = holey_events(spark, sf_dir)
    clicks = ev.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    purchases = ev.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    found = interval_join(
        clicks, purchases, ["user_id"], "ts", "event_id", 6 * 3600, "purchases", "first_purchase_us"
    )
    return found.drop("ts")


@query("set_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return customers.union(load(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query(
    "set_intersect",
    """SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT ALL SELECT user_id FROM events WHERE event_type = 'purchase'""",
)
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    return ev.filter("event_type = 'signup'").select("user_id").intersectAll(
        ev.filter("event_type = 'purchase'").select("user_id")
    )


@query(
    "set_except",
    """SELECT user_id, 'distinct' AS kind FROM (SELECT user_id FROM events WHERE value > 15 EXCEPT SELECT user_id FROM events WHERE value > 60)
      UNION ALL SELECT user_id, 'all' FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'view')""",
)
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    once = ev.filter("value > 15").select("user_id").subtract(ev.filter("value > 60").select("user_id"))
    every = ev.filter("event_type = 'click'").select("user_id").exceptAll(
        ev.filter("event_type = 'view'").select("user_id")
    )
    return once.withColumn("kind", F.lit("distinct")).unionByName(every.withColumn("kind", F.lit("all")))


@query(
    "subq_correlated",
    """SELECT p_brand, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem JOIN part ON p_partkey = l_partkey
      WHERE l_quantity < (SELECT 0.2 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey) GROUP BY 1""",
)
def subq_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        """
        SELECT p_brand, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price
        FROM {lines} l JOIN {part} p ON p.p_partkey = l.l_partkey
        WHERE l.l_quantity < (SELECT 0.2 * avg(l2.l_quantity) FROM {lines} l2 WHERE l2.l_partkey = p.p_partkey)
        GROUP BY p_brand
        """,
        lines=load(spark, sf_dir, "lineitem"),
        part=load(spark, sf_dir, "part"),
    )


@query(
    "cte_recursive",
    """WITH RECURSIVE heads AS (SELECT max(c_custkey) AS head FROM customer GROUP BY c_nationkey),
      chain AS (SELECT head, head AS custkey, 0 AS depth FROM heads
        UNION ALL SELECT chain.head, c.c_custkey, chain.depth + 1 FROM chain JOIN customer c ON c.c_custkey = chain.custkey // 2 WHERE chain.custkey > 1)
      SELECT head, custkey, depth FROM chain""",
)
def cte_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the last customer of each nation up a tree in which customer k hangs below k / 2."""
    return spark.sql(
        """
        WITH RECURSIVE chain AS (
          SELECT max(c_custkey) AS head, max(c_custkey) AS custkey, 0 AS depth FROM {customer} GROUP BY c_nationkey
          UNION ALL
          SELECT chain.head, c.c_custkey, chain.depth + 1
          FROM chain JOIN {customer} c ON c.c_custkey = chain.custkey DIV 2 WHERE chain.custkey > 1)
        SELECT head, custkey, depth FROM chain
        """,
        customer=load(spark, sf_dir, "customer"),
    )
