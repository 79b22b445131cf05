"""Patterns of rows, and answers from stored parts: sketches, bitmaps, digests, state and clustered files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.operators.drift import drift, hashed_leaf, write_snapshot
from lakestream.operators.patterns import match_pattern
from lakestream.operators.rollups import (
    HLL_ERROR,
    KLL_ERROR,
    bitmaps,
    distinct_rollup,
    merge_sketches,
    read_sketches,
    sketches,
)
from lakestream.operators.sampling import weighted_sample
from lakestream.plans.errors import PRINT_SQL, EDITED_SQL, customer_columns, edited_customer
from lakestream.plans.fixtures import HOLES_SQL, holey_events
from lakestream.plans.registry import query
from lakestream.session import load, stream_session, work_dir
from lakestream.sources.clustered import write_clustered
from lakestream.sources.stream import stage_files, stream_source
from lakestream.streaming.sink import run_available, upsert_to
from lakestream.streaming.snapshots import state_rows

_STEPS = "('view', 'click', 'purchase', 'error')"


@query(
    "match_pattern",
    f"""WITH {HOLES_SQL}, s AS (SELECT *, lag(CASE WHEN event_type <> 'click' THEN struct_pack(id := event_id, t := event_type, at := ts) END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM e WHERE ts IS NOT NULL AND event_type IN {_STEPS})
      SELECT user_id, last.id AS start_event_id, event_id AS end_event_id, last.at AS start_ts, ts AS end_ts FROM s
      WHERE event_type = 'purchase' AND last.t = 'view' AND ts - last.at <= INTERVAL 6 HOUR""",
)
def match_view_to_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view, any clicks, and a purchase within six hours of the view; an error or another purchase between ends it."""
    kind = F.col("event_type")
    symbols = {name: kind == name for name in ("view", "click", "purchase", "error")}
    steps = [("view", "1"), ("click", "*"), ("purchase", "1")]
    return match_pattern(holey_events(spark, sf_dir), ["user_id"], "ts", "event_id", symbols, steps, within_seconds=6 * 3600)


@query(
    "drift_tree",
    f"""WITH {EDITED_SQL}, o AS (SELECT c_custkey, {PRINT_SQL} AS old_print FROM customer), n AS (SELECT c_custkey, {PRINT_SQL} AS new_print FROM edited)
      SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, old_print, new_print,
        CASE WHEN old_print IS NULL THEN 'added' WHEN new_print IS NULL THEN 'removed' WHEN old_print <> new_print THEN 'changed' ELSE 'same' END AS change
      FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""",
)
def drift_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored snapshots compared by their digests; only rows of differing leaves are joined."""
    base, key, levels = work_dir(spark, "drift"), ["c_custkey"], 4
    versions = {"old": load(spark, sf_dir, "customer"), "new": edited_customer(spark, sf_dir)}
    for name, rows in versions.items():
        write_snapshot(rows, f"{base}/{name}", key, customer_columns(), hashed_leaf(key, levels), levels, band_levels=1)
    return drift(spark, f"{base}/old", f"{base}/new", key, levels, band_levels=1)


@query(
    "sketch_rollup",
    "SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n, true AS users_within, true AS quartiles_within, true AS merge_order_free FROM events GROUP BY 1, 2",
)
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches stored by day and merged to months, next to exact values: within five standard errors, ranks within theirs."""
    events = load(spark, sf_dir, "events").select("event_type", "user_id", "value", F.to_date("ts").alias("day"))
    path = work_dir(spark, "sketches")
    sketches(events, ["event_type", "day"], "user_id", "value").write.parquet(path)
    days = spark.read.parquet(path).withColumn("month", F.date_format("day", "yyyy-MM"))
    keys, fractions = ["event_type", "month"], [0.25, 0.5, 0.75]
    months = read_sketches(merge_sketches(days, keys), fractions)
    # weeks first and then months: merging is associative
    weeks = merge_sketches(days.withColumn("week", F.weekofyear("day")), [*keys, "week"])
    twice = read_sketches(merge_sketches(weeks, keys), fractions).select(*keys, F.col("distinct").alias("again"))

    rows = events.withColumn("month", F.date_format("day", "yyyy-MM"))
    at = [F.element_at("quantiles", i + 1) for i in range(3)]
    ranks = [(F.count_if(F.col("value") < v), F.count_if(F.col("value") <= v)) for v in at]
    valued = F.count("value")
    within = [
        (below <= (f + KLL_ERROR) * valued + 1) & (upto >= (f - KLL_ERROR) * valued - 1)
        for f, (below, upto) in zip(fractions, ranks, strict=True)
    ]
    ranked = rows.join(months.select(*keys, "quantiles"), keys).groupBy(*keys).agg((within[0] & within[1] & within[2]).alias("quartiles_within"))
    exact = rows.groupBy(*keys, "user_id").count().groupBy(*keys).agg(F.count("user_id").alias("exact"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 5 * HLL_ERROR * F.col(b) + 1
    joined = months.join(exact, keys).join(ranked, keys).join(twice, keys)
    return joined.select(
        *keys, "n", near("distinct", "exact").alias("users_within"), "quartiles_within", near("again", "distinct").alias("merge_order_free")
    )


@query(
    "distinct_rollup",
    "SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (1, 2)",
)
def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct users by type and month, by type, and in all, from bitmaps stored by day."""
    events = load(spark, sf_dir, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    path = work_dir(spark, "bitmaps")
    bitmaps(events, ["event_type", "day"], "user_id").write.parquet(path)
    days = spark.read.parquet(path).withColumn("month", F.date_format("day", "yyyy-MM"))
    return distinct_rollup(days, ["event_type", "month"], "users")


@query(
    "sample_weighted",
    """WITH u AS (SELECT o_orderkey, o_orderpriority, o_totalprice, (CAST('0x' || substr(sha256('7:' || o_orderkey), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
        FROM orders WHERE o_totalprice > 0)
      SELECT o_orderkey, o_orderpriority, row_number() OVER w AS draw FROM u
      WINDOW w AS (PARTITION BY o_orderpriority ORDER BY -ln(u) / o_totalprice, o_orderkey) QUALIFY draw <= 50""",
)
def sample_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty orders of each priority, drawn in proportion to their price."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    drawn = weighted_sample(orders, ["o_orderpriority"], "o_orderkey", "o_totalprice", 50, seed=7)
    return drawn.select("o_orderkey", "o_orderpriority", F.col("draw").cast("long").alias("draw"))


@query(
    "state_snapshot",
    """SELECT 'first' AS state, user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 2
      UNION ALL SELECT 'last', user_id, count(*) FROM events GROUP BY 2""",
)
def state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stopped job's checkpoint holds per user, after its first batch and after its last one."""
    base, session = work_dir(spark, "snapshot"), stream_session(spark)
    events = load(spark, sf_dir, "events").select("event_id", "user_id")
    for half in (0, 1):
        stage_files(events.filter(F.col("event_id") % 2 == half), f"{base}/in", "event_id")
        counts = stream_source(session, f"{base}/in", events.schema, bounded=False).groupBy("user_id").agg(F.count("*").alias("n"))
        run_available(counts, upsert_to(f"{base}/table", ["user_id"], ["n"]), f"{base}/checkpoint", mode="update")
    states = [("first", 0), ("last", None)]
    first, last = [
        state_rows(session, f"{base}/checkpoint", batch).select(F.lit(name).alias("state"), "user_id", F.col("count").alias("n"))
        for name, batch in states
    ]
    return first.unionByName(last)


@query(
    "scan_clustered",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey <= 20
      UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey = 3
      UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01'""",
)
def scan_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow scans of one table by each of the three columns it is clustered on."""
    path = work_dir(spark, "clustered")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    write_clustered(lines, path, ["l_partkey", "l_suppkey", "l_shipdate"], files=64)
    stored = spark.read.parquet(path)
    early = F.col("l_shipdate") < F.lit("1995-02-01").cast("timestamp_ntz")
    scans = [stored.filter(c).drop("l_shipdate") for c in (F.col("l_partkey") <= 20, F.col("l_suppkey") == 3, early)]
    return scans[0].unionByName(scans[1]).unionByName(scans[2])
