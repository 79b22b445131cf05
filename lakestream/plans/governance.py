"""Schema versions: compatibility, latest schema, effective level, conformance of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestream.functions.naming import layer_compatibility, with_topic_parts
from lakestream.operators.errors import split_errors
from lakestream.operators.governance import check_compat, conformance, conformance_checks, effective_level, latest_schema
from lakestream.operators.ordered import number_rows
from lakestream.plans.fixtures import DAMAGED_SQL, damaged_events, pick
from lakestream.plans.registry import query
from lakestream.session import load, work_dir
from lakestream.sources.lake import append, read_log

# Each order is one registered schema version of its customer's subject. Its fields follow from the order key:
# (name, is it there, type, nullable, has default), written once for Spark and once for SQL.
_FIELDS = (
    ("id", "true", "CASE WHEN o_orderkey % 7 = 0 THEN 'long' ELSE 'int' END", "false", "false"),
    ("amount", "true", "CASE WHEN o_orderkey % 5 = 0 THEN 'float' ELSE 'double' END", "true", "true"),
    ("note", "o_orderkey % 3 <> 0", "'string'", "o_orderkey % 2 = 0", "o_orderkey % 4 <> 1"),
    ("extra", "o_orderkey % 4 = 0", "'string'", "true", "o_orderkey % 8 = 0"),
)

VERSIONS_SQL = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version,
    list_extract(['bronze','silver','gold'], CAST(o_custkey % 3 + 1 AS INT)) || '.m3.c' || o_custkey AS topic FROM orders),
versions AS (
""" + " UNION ALL ".join(
    f"SELECT topic || '-value' AS subject, version, '{n}' AS field, {t} AS type, {u} AS nullable, {d} AS has_default FROM numbered WHERE {there}"
    for n, there, t, u, d in _FIELDS
) + """),
levels AS (
  SELECT topic, topic || '-value' AS subject, explicit, layer_level, coalesce(explicit, layer_level, 'BACKWARD') AS level FROM (
    SELECT list_extract(['bronze','silver','gold'], CAST(c_custkey % 3 + 1 AS INT)) || '.m3.c' || c_custkey AS topic,
      CASE c_custkey % 5 WHEN 0 THEN 'FORWARD' WHEN 1 THEN 'FULL' END AS explicit,
      list_extract(['NONE','BACKWARD','FULL'], CAST(c_custkey % 3 + 1 AS INT)) AS layer_level FROM customer))"""


def _topic(key: str):
    layer = pick(("bronze", "silver", "gold"), F.col(key))
    return F.concat(layer, F.lit(".m3.c"), F.col(key).cast("string"))


def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions, numbered in the order of registration."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    band = F.floor(F.col("o_orderkey") / 65536).cast("long")
    numbered = number_rows(
        orders.withColumn("_band", band), ["o_custkey"], "_band", [F.col("o_orderkey")], "version"
    )
    fields = F.array(
        *[
            F.when(
                F.expr(there),
                F.struct(
                    F.lit(name).alias("field"),
                    F.expr(kind).alias("type"),
                    F.expr(nullable).alias("nullable"),
                    F.expr(default).alias("has_default"),
                ),
            )
            for name, there, kind, nullable, default in _FIELDS
        ]
    )
    return numbered.select(
        F.concat(_topic("o_custkey"), F.lit("-value")).alias("subject"),
        F.col("version").cast("long").alias("version"),
        F.inline(F.array_compact(fields)),
    )


def stored(spark: SparkSession, versions: DataFrame) -> DataFrame:
    """For what reads the versions twice."""
    path = work_dir(spark, "versions")
    append(versions, path, 0)
    return read_log(spark, path).drop("commit")


def topics_with_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer").select("c_custkey", _topic("c_custkey").alias("topic"))
    explicit = F.when(F.col("c_custkey") % 5 == 0, "FORWARD").when(F.col("c_custkey") % 5 == 1, "FULL")
    return with_topic_parts(customer).select(
        "topic",
        F.concat("topic", F.lit("-value")).alias("subject"),
        explicit.alias("explicit"),
        layer_compatibility(F.col("layer")).alias("layer_level"),
        effective_level(explicit, layer_compatibility(F.col("layer"))).alias("level"),
    )


@query("effective_level", f"WITH {VERSIONS_SQL} SELECT topic, explicit, layer_level, level FROM levels")
def effective_level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics_with_levels(spark, sf_dir).select("topic", "explicit", "layer_level", "level")


_COMPAT_SQL = f"""WITH {VERSIONS_SQL},
pairs AS (SELECT DISTINCT subject, version FROM versions WHERE version > 1),
old AS (SELECT subject, version + 1 AS version, field, type AS ot, nullable AS onull, has_default AS od FROM versions
  WHERE (subject, version + 1) IN (SELECT subject, version FROM pairs)),
new AS (SELECT subject, version, field, type AS nt, nullable AS nnull, has_default AS nd FROM versions WHERE version > 1),
both_ AS (SELECT coalesce(o.subject, n.subject) AS subject, coalesce(o.version, n.version) AS version, coalesce(o.field, n.field) AS field,
  ot, onull, od, nt, nnull, nd FROM old o FULL JOIN new n ON o.subject = n.subject AND o.version = n.version AND o.field = n.field),
some_levels AS (SELECT * FROM levels WHERE CAST(regexp_extract(topic, '[0-9]+$') AS BIGINT) % 11 <> 0),
judged AS (SELECT b.*, coalesce(l.level, 'BACKWARD') AS level,
  CASE WHEN coalesce(l.level, 'BACKWARD') IN ('BACKWARD','FULL') THEN CASE WHEN ot IS NULL THEN CASE WHEN NOT nd THEN 'added without default' END WHEN nt IS NULL THEN NULL
    WHEN NOT (ot = nt OR (ot = 'int' AND nt = 'long') OR (ot = 'float' AND nt = 'double')) THEN 'type not readable'
    WHEN onull AND NOT nnull THEN 'null not readable' END END AS bad_back,
  CASE WHEN level IN ('FORWARD','FULL') THEN CASE WHEN nt IS NULL THEN CASE WHEN NOT od THEN 'removed without default' END WHEN ot IS NULL THEN NULL
    WHEN NOT (ot = nt OR (nt = 'int' AND ot = 'long') OR (nt = 'float' AND ot = 'double')) THEN 'type not readable by old'
    WHEN NOT onull AND nnull THEN 'null not readable by old' END END AS bad_forward
  FROM both_ b LEFT JOIN some_levels l ON b.subject = l.subject),
found AS (SELECT subject, version, level, field || ':' || bad_back AS v FROM judged UNION ALL SELECT subject, version, level, field || ':' || bad_forward FROM judged)
SELECT subject, version, level, coalesce(string_agg(v, ', ' ORDER BY v), '') AS violations, count(v) = 0 AS ok FROM found GROUP BY 1, 2, 3"""


@query("schema_compat", _COMPAT_SQL)
def schema_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh customer's subject has no level of its own and is checked by the default one."""
    number = F.regexp_extract("topic", "[0-9]+$", 0).cast("long")
    levels = topics_with_levels(spark, sf_dir).filter(number % 11 != 0)
    return check_compat(schema_versions(spark, sf_dir), levels)


@query(
    "latest_schema",
    f"""WITH {VERSIONS_SQL}, asked AS (SELECT topic FROM levels UNION ALL SELECT 'missing.' || topic FROM levels),
      newest AS (SELECT subject, version, string_agg(field || ':' || type, ', ' ORDER BY field) AS fields FROM versions
        WHERE (subject, version) IN (SELECT subject, max(version) FROM versions GROUP BY subject) GROUP BY 1, 2)
      SELECT topic || '-value' AS subject, topic, version, fields, version IS NOT NULL AS schema_found
      FROM asked LEFT JOIN newest ON topic || '-value' = subject""",
)
def latest_schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = topics_with_levels(spark, sf_dir).select(
        F.explode(F.array("topic", F.concat(F.lit("missing."), "topic"))).alias("topic")
    )
    return latest_schema(topics, stored(spark, schema_versions(spark, sf_dir)))


@query(
    "conformance",
    f"""WITH {DAMAGED_SQL}
      SELECT 'user_id' AS field, count(*) FILTER (WHERE user_id IS NULL) AS missing, 0::BIGINT AS bad_type FROM damaged
      UNION ALL SELECT 'amount', count(*) FILTER (WHERE amount IS NULL), count(*) FILTER (WHERE amount = 'x') FROM damaged
      UNION ALL SELECT 'iceberg_table', count(*) FILTER (WHERE iceberg_table IS NULL), 0 FROM damaged
      UNION ALL SELECT 'raw_value', 0, count(*) FROM damaged""",
)
def conformance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance(damaged_events(spark, sf_dir), _RECORD)


@query(
    "conform_dlq",
    f"""WITH {DAMAGED_SQL}, judged AS (SELECT *, CASE WHEN user_id IS NULL THEN 'user_id:missing' WHEN amount IS NULL THEN 'amount:missing' WHEN amount = 'x' THEN 'amount:type'
        WHEN iceberg_table IS NULL THEN 'iceberg_table:missing' END AS message FROM damaged)
      SELECT 'good' AS place, "offset", NULL AS error_class, NULL AS error_message FROM judged WHERE message IS NULL
      UNION ALL SELECT 'events_dlq', "offset", CASE WHEN message LIKE '%type' THEN 'WrongType' ELSE 'MissingField' END, message FROM judged WHERE message IS NOT NULL""",
)
def conform_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that do not conform to their schema become dead letters; the rest goes on."""
    schema = {name: kind for name, kind in _RECORD.items() if name != "raw_value"}
    good, bad = split_errors(
        damaged_events(spark, sf_dir), conformance_checks(schema), "conform", ["offset"], F.lit("events_dlq")
    )
    letters = bad.select(F.col("dlq_topic").alias("place"), "offset", "error_class", "error_message")
    return good.select(F.lit("good").alias("place"), "offset").unionByName(letters, allowMissingColumns=True)


_RECORD = {
    "user_id": ("bigint", True),
    "amount": ("decimal(18,2)", True),
    "iceberg_table": ("string", True),
    "raw_value": ("int", False),
}
