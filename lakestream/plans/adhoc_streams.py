"""Event-time windows, late data, deduplication and timers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.plans.registry import query
from lakestream.session import load, stream_session, work_dir
from lakestream.sources.lake import read_log, read_upserted
from lakestream.sources.stream import stage_files, stream_source
from lakestream.streaming.progress import Progress, metered, watched
from lakestream.streaming.sink import append_to, run_available, upsert_to
from lakestream.streaming.state import session_timeout


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned time: watermarks do not take a time without zone."""
    return load(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")
    )


def _hourly(events: DataFrame) -> DataFrame:
    windows = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")
    )
    return windows.select(
        F.col("window.start").cast("timestamp_ntz").alias("hour"),
        "event_type",
        "n",
        F.col("total").cast("double").alias("total"),
    )


_HOURLY_SQL = """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM events GROUP BY 1, 2"""


@query("tumble_hourly", _HOURLY_SQL)
def tumble_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(timed_events(spark, sf_dir))


@query("tumble_hourly_stream", _HOURLY_SQL)
def tumble_hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows kept by a stream: each batch upserts the windows it changed."""
    base = work_dir(spark, "tumble")
    events = timed_events(spark, sf_dir)
    stage_files(events, f"{base}/in", "event_id")
    stream = stream_source(stream_session(spark), f"{base}/in", events.schema)
    keys = ["hour", "event_type"]
    hourly = _hourly(stream.withWatermark("ts", "40 days"))
    run_available(hourly, upsert_to(f"{base}/table", keys, ["n"]), f"{base}/checkpoint", mode="update")
    return read_upserted(spark, f"{base}/table", keys, ["n"])


@query(
    "hop_window",
    """SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * i) AS start, event_type, count(*) AS n
      FROM events, range(0, 2) r(i) GROUP BY 1, 2""",
)
def hop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = timed_events(spark, sf_dir).groupBy(F.window("ts", "1 hour", "30 minutes"), "event_type").agg(
        F.count("*").alias("n")
    )
    return hops.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


SLICES = 2


def run_in_order(
    events: DataFrame, order: str, base: str, build: Callable[[DataFrame], DataFrame]
) -> Progress:
    """Feed events to one query in slices of ``order``, resuming it from its checkpoint for each slice.

    A slice is one micro-batch: the files of a slice are in no order among themselves. Returns what all batches reported.
    """
    session = stream_session(events.sparkSession)
    low, high = events.agg(F.min(order), F.max(order)).first()
    step = (high - low) // SLICES + 1
    with watched(session) as progress:
        for number in range(SLICES):
            begin = low + number * step
            stage_files(events.filter(F.col(order).between(begin, begin + step - 1)), f"{base}/in", order)
            stream = stream_source(session, f"{base}/in", events.schema, bounded=False)
            progress.wait(run_available(build(stream), append_to(f"{base}/out"), f"{base}/checkpoint"))
    return progress


@query(
    "late_data",
    f"""WITH e AS (SELECT epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 + CASE WHEN event_id % 10 = 0 THEN 864000 ELSE 0 END AS arrival FROM events),
      b AS (SELECT min(arrival) AS low, (max(arrival) - min(arrival)) // {SLICES} + 1 AS step FROM e),
      s AS (SELECT ms, (ms // 3600000 + 1) * 3600000 AS window_end, (arrival - low) // step AS slice FROM e, b),
      w AS (SELECT slice, max(max(ms)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000 AS mark FROM s GROUP BY slice),
      kept AS (SELECT s.*, coalesce(window_end > mark, true) AS on_time FROM s JOIN w ON s.slice = w.slice)
      SELECT count(*) AS rows_read, count(*) FILTER (WHERE on_time AND window_end <= (SELECT max(ms) - 3600000 FROM e)) AS rows_emitted,
        count(*) FILTER (WHERE NOT on_time) > 0 AS any_late FROM kept""",
)
def late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event arrives ten days late; what the watermark dropped is read from query progress."""
    base = work_dir(spark, "late")
    arrival = F.unix_seconds("ts") + F.when(F.col("event_id") % 10 == 0, 10 * 86_400).otherwise(0)

    def hourly(stream: DataFrame) -> DataFrame:
        windows = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type")
        return windows.agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")

    progress = run_in_order(timed_events(spark, sf_dir).withColumn("arrival", arrival), "arrival", base, hourly)
    emitted = read_log(spark, f"{base}/out").agg(F.sum("n").alias("rows_emitted"))
    # the operator counts the partial aggregates it dropped, not the source rows behind them
    return emitted.select(
        F.lit(progress.rows_read).cast("long").alias("rows_read"), "rows_emitted", F.lit(progress.rows_dropped > 0).alias("any_late")
    )


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice; the second copy within the watermark is dropped."""
    base = work_dir(spark, "dedup")
    events = timed_events(spark, sf_dir)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    stage_files(twice, f"{base}/in", ["copy", "event_id"])
    stream = stream_source(stream_session(spark), f"{base}/in", twice.schema)
    once = stream.withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"])
    run_available(once.select("event_id", "user_id", "event_type"), append_to(f"{base}/out"), f"{base}/checkpoint")
    return read_log(spark, f"{base}/out").drop("commit")


@query(
    "state_session_timeout",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events),
      g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) < 1800000 THEN 0 ELSE 1 END AS fresh FROM e),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
      SELECT user_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n FROM s GROUP BY user_id, sid
      HAVING max(ms) + 1800000 + 60000 <= (SELECT max(ms) - 3600000 FROM e)""",
)
def state_session_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions closed by timers after 30 minutes without events; the newest ones are still open at the end."""
    base = work_dir(spark, "timeout")
    events = timed_events(spark, sf_dir).select("user_id", "ts", F.unix_seconds("ts").alias("second"))
    run_in_order(events, "second", base, lambda s: session_timeout(s, "ts", 30 * 60 * 1000, "1 hour", 60))
    return read_log(spark, f"{base}/out").drop("commit")


@query(
    "stream_sink_metrics",
    """SELECT count(*) AS records, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(sum(event_id) AS BIGINT) AS ids FROM events""",
)
def stream_sink_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics a sink's batches report while they are written, summed, next to what the table holds."""
    base = work_dir(spark, "metrics")
    events = timed_events(spark, sf_dir)
    stage_files(events, f"{base}/in", "event_id")
    session = stream_session(spark)
    stream = metered(
        stream_source(session, f"{base}/in", events.schema),
        "sink",
        {"records": F.count("*"), "errors": F.count_if(F.col("event_type") == "error")},
    )
    with watched(session) as progress:
        progress.wait(run_available(stream, append_to(f"{base}/out"), f"{base}/checkpoint"))
    live = progress.observed
    return read_log(spark, f"{base}/out").agg(F.sum("event_id").alias("ids")).select(
        F.lit(live["sink.records"]).cast("long").alias("records"), F.lit(live["sink.errors"]).cast("long").alias("errors"), "ids"
    )
