"""Lake tables: append, upsert, partitions, evolution, streaming commits, compaction, retention."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestream.operators.evolution import union_evolved
from lakestream.operators.latest import (
    clean,
    compact,
    current_rows,
    latest_per_key,
    resolve_ids,
    retain,
    upsert,
    upsert_small,
)
from lakestream.plans.fixtures import BRONZE_SQL, HOLES_SQL, bronze_records, holey_events
from lakestream.plans.registry import query
from lakestream.session import load, stream_session, work_dir
from lakestream.sources.lake import (
    append,
    fold,
    read_log,
    read_upserted,
    table_exists,
    upsert_commit,
)
from lakestream.sources.stream import stage_files, stream_source
from lakestream.streaming.sink import run_available, shifted, upsert_routed_to, upsert_to, upsert_topics_to

_LATEST_USER = "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY \"offset\" DESC) = 1"


@query("sink_append", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "append")
    ev = load(spark, sf_dir, "events")
    append(ev.filter("event_id % 2 = 0"), path, 0)
    append(ev.filter("event_id % 2 = 1"), path, 1)
    return read_log(spark, path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("upsert_global", f"WITH {BRONZE_SQL} SELECT * FROM bronze {_LATEST_USER}")
def upsert_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bronze_records(spark, sf_dir)
    stored = latest_per_key(rows.filter("offset % 3 <> 0"), ["user_id"], ["offset"])
    return upsert(stored, rows.filter("offset % 3 = 0"), ["user_id"], ["offset"])


@query("upsert_small_batch", f"WITH {BRONZE_SQL} SELECT * FROM bronze {_LATEST_USER}")
def upsert_small_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table and a batch a tenth of its size."""
    base = work_dir(spark, "small_batch")
    rows = bronze_records(spark, sf_dir)
    append(latest_per_key(rows.filter("offset % 10 <> 0"), ["user_id"], ["offset"]), f"{base}/table", 0)
    append(rows.filter("offset % 10 = 0"), f"{base}/batch", 0)
    stored, batch = (read_log(spark, f"{base}/{name}").drop("commit") for name in ("table", "batch"))
    return upsert_small(stored, batch, ["user_id"], ["offset"])


@query(
    "upsert_partition_scope",
    f"WITH {BRONZE_SQL} SELECT * FROM bronze QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY \"offset\" DESC) = 1",
)
def upsert_partition_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "partition_scope")
    rows = bronze_records(spark, sf_dir)
    options = {"ids": ["user_id"], "order": ["offset"], "partition_by": "event_type", "scope": "partition"}
    for commit in range(2):
        upsert_commit(rows.filter(F.col("offset") % 2 == commit), path, commit, **options)
    return read_upserted(spark, path, **options).select(*rows.columns)


@query("upsert_multi_batch", f"WITH {BRONZE_SQL} SELECT * FROM bronze {_LATEST_USER}")
def upsert_multi_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches whose offsets interleave, then the commits folded into a base."""
    path = work_dir(spark, "multi_batch")
    rows = bronze_records(spark, sf_dir)
    for commit in range(3):
        upsert_commit(rows.filter(F.col("offset") % 3 == commit), path, commit, ["user_id"], ["offset"])
    fold(spark, path, ["user_id"], ["offset"])
    return read_log(spark, path).select(*rows.columns)


@query("fold_and_replay", f"WITH {BRONZE_SQL} SELECT * FROM bronze {_LATEST_USER}")
def fold_and_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches are folded, the last one and an empty one are replayed, and a third comes on top; then once more."""
    path = work_dir(spark, "fold_replay")
    rows = bronze_records(spark, sf_dir)
    for commit in (0, 1, "fold", 1, 2, 2, 3, "fold", 3, 0, 4):
        if commit == "fold":
            fold(spark, path, ["user_id"], ["offset"])
        else:
            upsert_commit(rows.filter(F.col("offset") % 4 == commit), path, commit, ["user_id"], ["offset"])
    return read_upserted(spark, path, ["user_id"], ["offset"]).select(*rows.columns)


_LINE = (
    "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,"
    " l_returnflag, l_linestatus"
)


@query(
    "upsert_lineitem",
    f"""SELECT {_LINE} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC,
      l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1""",
)
def upsert_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _LINE.split(", ")
    lines = load(spark, sf_dir, "lineitem").select(*columns)
    # rows of a key tie on every natural order, so all columns break ties
    old, new = lines.filter("l_suppkey % 2 = 0"), lines.filter("l_suppkey % 2 = 1")
    return upsert(old, new, columns[:2], columns[2:])


@query(
    "upsert_default_key",
    """SELECT CAST(o_custkey AS VARCHAR) AS record_key, o_orderkey, o_totalprice FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
)
def upsert_default_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Fixed value: the default id column of a routed sink.
    ids = resolve_ids("silver.orders", {"silver.other": ["id"]}, ["record_key"])
    rows = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("record_key"), "o_orderkey", "o_totalprice"
    )
    return latest_per_key(rows, ids, ["o_orderkey"])


@query("partitioned_write", "SELECT s_nationkey, count(*) AS n, max(s_suppkey) AS last_key FROM supplier GROUP BY 1")
def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "partitioned")
    append(load(spark, sf_dir, "supplier"), path, 0, partition_by="s_nationkey")
    rows = read_log(spark, path)
    return rows.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_suppkey").alias("last_key"))


@query(
    "auto_create",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, false AS existed FROM customer",
)
def auto_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "auto_create")
    existed = table_exists(spark, path)
    customer = load(spark, sf_dir, "customer")
    append(customer, path, 0)
    return read_log(spark, path).select(*customer.columns, F.lit(existed).alias("existed"))


@query(
    "evolve_add_column",
    """SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS c_mktsegment FROM customer""",
)
def evolve_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "evolve_add")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    append(customer.filter("c_custkey % 2 = 0").drop("c_mktsegment"), path, 0)
    append(customer.filter("c_custkey % 2 = 1"), path, 1)
    return read_log(spark, path).select(*customer.columns)


@query(
    "evolve_widen",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE c_nationkey + 10000000000 END AS c_nationkey FROM customer""",
)
def evolve_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "evolve_widen")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    wide = customer.withColumn("c_nationkey", F.col("c_nationkey").cast("long") + F.lit(10_000_000_000))
    append(customer.filter("c_custkey % 2 = 0"), path, 0)
    append(wide.filter("c_custkey % 2 = 1"), path, 1)
    return read_log(spark, path).select(*customer.columns)


@query(
    "evolve_union",
    """SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, NULL::VARCHAR AS c_mktsegment FROM customer
      UNION ALL SELECT c_custkey, c_nationkey + 10000000000, c_mktsegment FROM customer""",
)
def evolve_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    wide = customer.select(
        "c_custkey", (F.col("c_nationkey").cast("long") + F.lit(10_000_000_000)).alias("c_nationkey"), "c_mktsegment"
    )
    return union_evolved(customer.select("c_custkey", "c_nationkey"), wide)


@query(
    "force_optional",
    """SELECT 'key' AS column_name, count(event_id) AS n, count(*) FILTER (WHERE event_id IS NULL) AS nulls FROM events
      UNION ALL SELECT 'flag', count(*) FILTER (WHERE event_id % 2 = 0), count(*) FILTER (WHERE event_id % 2 = 1) FROM events
      UNION ALL SELECT 'items', count(*) FILTER (WHERE event_id % 3 = 0), count(*) FILTER (WHERE event_id % 3 > 0) FROM events""",
)
def force_optional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required columns in the first batch, nulls in the same columns after it: both are in the table."""
    path = work_dir(spark, "optional")
    events = load(spark, sf_dir, "events").select(F.coalesce("event_id", F.lit(0)).alias("key"))
    required = events.filter("key % 6 = 0").select("key", F.lit(True).alias("flag"), F.array(F.lit(1)).alias("items"))
    later = events.filter("key % 6 <> 0").select(
        "key", F.when(F.col("key") % 2 == 0, F.lit(True)).alias("flag"), F.when(F.col("key") % 3 == 0, F.array(F.lit(1))).alias("items")
    )
    append(required, path, 0)
    append(later, path, 1)
    facts = [
        F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"))
        for c in ("key", "flag", "items")
    ]
    return read_log(spark, path).agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


@query(
    "evolve_stream_upsert",
    """SELECT 'table' AS place, c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_nationkey + 10000000000 ELSE c_nationkey END AS c_nationkey,
        CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 < 2
      UNION ALL SELECT 'dead letters', c_custkey, NULL, NULL FROM customer WHERE c_custkey % 3 = 2""",
)
def evolve_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose later files add and widen columns, and at last change a type the table cannot hold."""
    base = work_dir(spark, "evolve_stream")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    wide = F.col("c_nationkey").cast("long") + F.lit(10_000_000_000)
    forms = (
        customer.drop("c_mktsegment"),
        customer.withColumn("c_nationkey", wide),
        customer.withColumn("c_nationkey", F.concat(F.lit("n"), "c_nationkey")),
    )
    session = stream_session(spark)
    for number, form in enumerate(forms):
        stage_files(form.filter(F.col("c_custkey") % 3 == number), f"{base}/in{number}", "c_custkey")
        stream = stream_source(session, f"{base}/in{number}", form.schema)
        # a run of its own per schema, as a job restarted for it; batch numbers go on
        sink = upsert_to(f"{base}/table", ["c_custkey"], ["c_custkey"], dlq_path=f"{base}/letters")
        run_available(stream, shifted(sink, number * 1000), f"{base}/checkpoint{number}")
    table = read_upserted(spark, f"{base}/table", ["c_custkey"], ["c_custkey"]).select(
        F.lit("table").alias("place"), "c_custkey", "c_nationkey", "c_mktsegment"
    )
    letters = read_log(spark, f"{base}/letters").select(
        F.lit("dead letters").alias("place"), F.get_json_object("record", "$.c_custkey").cast("long").alias("c_custkey")
    )
    return table.unionByName(letters, allowMissingColumns=True)


def _bronze_stream(spark: SparkSession, sf_dir: str, base: str, shuffled: bool) -> tuple[DataFrame, DataFrame]:
    """Bronze records and the same as a stream of files, in offset order or dealt out by hash."""
    rows = bronze_records(spark, sf_dir)
    staged = rows.withColumn("_place", F.xxhash64("offset") if shuffled else F.col("offset"))
    stage_files(staged, f"{base}/in", "_place")
    return rows, stream_source(stream_session(spark), f"{base}/in", staged.schema).drop("_place")


@query("stream_upsert_final", f"WITH {BRONZE_SQL} SELECT * FROM bronze {_LATEST_USER}")
def stream_upsert_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark, "stream_upsert")
    rows, stream = _bronze_stream(spark, sf_dir, base, shuffled=True)
    run_available(stream, upsert_to(f"{base}/table", ["user_id"], ["offset"]), f"{base}/checkpoint")
    return read_upserted(spark, f"{base}/table", ["user_id"], ["offset"]).select(*rows.columns)


@query(
    "stream_routed",
    f"""WITH {BRONZE_SQL} SELECT 'silver.' || event_type AS target, count(*) AS n, CAST(sum("offset") AS BIGINT) AS offsets FROM
      (SELECT * FROM bronze WHERE "offset" % 103 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY "offset" DESC) = 1) GROUP BY 1""",
)
def stream_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark, "stream_routed")
    _, stream = _bronze_stream(spark, sf_dir, base, shuffled=False)
    target = F.when(F.col("offset") % 103 != 0, F.concat(F.lit("Silver."), "event_type"))
    stream = stream.select(
        F.col("user_id").cast("string").alias("record_key"), target.alias("iceberg_table"), "offset"
    )
    commit = upsert_routed_to(f"{base}/tables", "iceberg_table", ["record_key"], ["offset"])
    run_available(stream, commit, f"{base}/checkpoint")
    tables = read_upserted(spark, f"{base}/tables", ["record_key"], ["offset"], "target", "partition")
    return tables.groupBy("target").agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"))


@query("replay_idempotent", f"WITH {BRONZE_SQL} SELECT count(*) AS n, CAST(sum(\"offset\") AS BIGINT) AS offsets FROM bronze")
def replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appended batches, each applied twice."""
    path = work_dir(spark, "replay")
    rows = bronze_records(spark, sf_dir)
    for commit in (0, 1, 1, 0):
        append(rows.filter(F.col("offset") % 2 == commit), path, commit)
    return read_log(spark, path).agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"))


@query(
    "current_view",
    f"WITH {BRONZE_SQL}, latest AS (SELECT * FROM bronze {_LATEST_USER}) SELECT * FROM latest WHERE __deleted <> 'true'",
)
def current_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(latest_per_key(bronze_records(spark, sf_dir), ["user_id"], ["offset"]))


@query(
    "soft_deleted_count",
    f"WITH {BRONZE_SQL}, latest AS (SELECT * FROM bronze {_LATEST_USER}) SELECT __deleted, count(*) AS n FROM latest GROUP BY 1",
)
def soft_deleted_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_per_key(bronze_records(spark, sf_dir), ["user_id"], ["offset"])
    return latest.groupBy("__deleted").agg(F.count("*").alias("n"))


NOW = "2024-01-31 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(
    "compact_log",
    f"""WITH {HOLES_SQL} SELECT event_id, ts, user_id, event_type FROM e WHERE ts >= TIMESTAMP '2024-01-24' OR ts IS NULL
      UNION ALL SELECT event_id, ts, user_id, event_type FROM (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-24'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)""",
)
def compact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = holey_events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    return compact(log, ["user_id"], "event_id", "ts", _now())


@query(
    "retention_delete",
    f"WITH {HOLES_SQL} SELECT event_id, ts, user_id FROM e WHERE ts >= TIMESTAMP '2024-01-17' OR ts IS NULL",
)
def retention_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = holey_events(spark, sf_dir).select("event_id", "ts", "user_id")
    return retain(log, "ts", _now(), timedelta(days=14))


@query(
    "compact_and_delete",
    """SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-24'
      UNION ALL SELECT event_id, ts, user_id FROM (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-24' AND ts >= TIMESTAMP '2024-01-17'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)""",
)
def compact_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return clean(log, "compact,delete", ["user_id"], "event_id", "ts", _now(), timedelta(days=14))


_TOPIC_FIELDS = {"silver.view": "k", "silver.click": "at", "silver.purchase": "amount"}


@query(
    "stream_routed_topics",
    """WITH r AS (SELECT event_id, user_id, event_id % 97 = 0 AS broken, CASE WHEN event_id % 103 <> 0 THEN 'silver.' || event_type END AS target FROM events),
      k AS (SELECT *, CASE WHEN target IS NULL THEN 'NoTarget' WHEN target NOT IN ('silver.view', 'silver.click', 'silver.purchase') THEN 'UnknownTarget' WHEN broken THEN 'BadRecord' END AS error_class FROM r)
      SELECT target, error_class, count(*) AS records, max(event_id) AS last_id FROM (SELECT * FROM k WHERE error_class IS NOT NULL
        UNION ALL SELECT * FROM k WHERE error_class IS NULL QUALIFY row_number() OVER (PARTITION BY target, user_id ORDER BY event_id DESC) = 1) GROUP BY 1, 2""",
)
def stream_routed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to tables with schemas of their own; unknown targets and broken records become dead letters."""
    base = work_dir(spark, "topics")
    events = load(spark, sf_dir, "events")
    fields = F.struct(
        "event_id", "user_id", F.length("props").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("value").alias("amount")
    )
    text = F.to_json(fields)
    broken = F.when(F.col("event_id") % 97 == 0, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    routed = F.when(F.col("event_id") % 103 != 0, F.concat(F.lit("Silver."), "event_type"))
    records = events.select("event_id", routed.alias("topic_field"), text.alias("value")).withColumn("value", broken)
    stage_files(records, f"{base}/in", "event_id")
    schemas = {
        target: T.StructType().add("event_id", "long").add("user_id", "long").add(name, "double" if name == "amount" else "long")
        for target, name in _TOPIC_FIELDS.items()
    }
    stream = stream_source(stream_session(spark), f"{base}/in", records.schema)
    commit = upsert_topics_to(f"{base}/tables", "topic_field", "value", schemas, ["user_id"], ["event_id"])
    run_available(stream, commit, f"{base}/checkpoint")
    letters = read_log(spark, f"{base}/tables/dead_letters")
    lost = letters.select("target", "error_class", F.get_json_object(F.concat(F.rtrim("record", F.lit("}")), F.lit("}")), "$.event_id").cast("long").alias("event_id"))
    found = lost
    for target in schemas:
        rows = read_upserted(spark, f"{base}/tables/{target}", ["user_id"], ["event_id"])
        found = found.unionByName(rows.select(F.lit(target).alias("target"), F.lit(None).cast("string").alias("error_class"), "event_id"))
    return found.groupBy("target", "error_class").agg(F.count("*").alias("records"), F.max("event_id").alias("last_id"))
