"""Change-capture inputs: feed modes, table filter, topic subscription, record decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestream.sources.stream import check_rate

SNAPSHOT_MODES = ("initial", "always", "never", "schema_only", "when_needed")


def cdc_feed(snapshot: DataFrame, changes: DataFrame, mode: str = "initial", has_offset: bool = False) -> DataFrame:
    """Snapshot rows as reads (``op = 'r'``) followed by change events, as the mode asks.

    ``snapshot`` has the key, offset and topic columns of ``changes`` and the row struct in ``row``.
    ``has_offset`` says that an earlier run stored its position.
    """
    mode = mode if mode in SNAPSHOT_MODES else "initial"
    wanted = {
        "always": True,
        "never": False,
        "schema_only": False,
        "initial": not has_offset,
        "when_needed": not has_offset,
    }
    if not wanted[mode]:
        return changes
    value_type = changes.schema["value"].dataType
    row_type = value_type["after"].dataType
    reads = F.struct(
        F.lit(None).cast(row_type).alias("before"),
        F.col("row").cast(row_type).alias("after"),
        F.lit("r").alias("op"),
        F.struct(
            F.lit(0).cast("long").alias("ts_ms"),
            F.col("source_schema").alias("schema"),
            F.col("source_table").alias("table"),
        ).alias("source"),
        F.lit(0).cast("long").alias("ts_ms"),
    ).cast(value_type)
    others = [c for c in changes.columns if c != "value"]
    return snapshot.select(*others, reads.alias("value")).unionByName(changes)


def read_snapshot(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **properties: str
) -> DataFrame:
    """Full read of a database table in ``partitions`` ranges of a numeric column."""
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    return spark.read.jdbc(url, table, column, lower, upper, partitions, properties=properties)


def _any_match(col: Column, patterns: Sequence[str]) -> Column:
    whole = "|".join(f"(?:{p.strip()})" for p in patterns)
    return col.rlike(f"(?i)^(?:{whole})$")


def filter_tables(
    df: DataFrame, table: Column, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None
) -> DataFrame:
    """Keep rows of the listed ``schema.table`` patterns; whole name, any case."""
    for patterns in (include, exclude):
        if patterns is not None and not any(p.strip() for p in patterns):
            raise ValueError("a table list cannot be empty")
    if include is not None:
        df = df.filter(_any_match(table, include))
    if exclude is not None:
        df = df.filter(~_any_match(table, exclude))
    return df


def chosen_topics(settings: dict[str, Sequence[str] | str | None]) -> tuple[str, Sequence[str] | str]:
    """The setting that counts, ``topics`` or ``pattern``: of several the last one given."""
    if set(settings) - {"topics", "pattern"}:
        raise TypeError(f"unknown settings: {sorted(set(settings) - {'topics', 'pattern'})}")
    given = [(name, value) for name, value in settings.items() if value is not None]
    if not given:
        raise ValueError("give topics or a pattern")
    return given[-1]


def subscribe(df: DataFrame, topic: str = "topic", **settings: Sequence[str] | str | None) -> DataFrame:
    """Records of the listed ``topics``, or of all topics whose whole name matches a ``pattern``; the last one wins."""
    name, value = chosen_topics(settings)
    if name == "topics":
        return df.filter(F.col(topic).isin(*value))
    return df.filter(F.col(topic).rlike(f"^(?:{value})$"))


def kafka_source(
    spark: SparkSession,
    servers: str,
    max_per_trigger: int | None = None,
    **settings: Sequence[str] | str | None,
) -> DataFrame:
    """Stream of a broker's ``topics`` or of those matching a ``pattern``, rate-limited when asked.

    Needs the Kafka module on the cluster.
    """
    name, value = chosen_topics(settings)
    choice = {"subscribe": ",".join(value)} if name == "topics" else {"subscribePattern": value}
    options = choice | {"kafka.bootstrap.servers": servers}
    if max_per_trigger is not None:
        check_rate(batch_rows=max_per_trigger)
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return spark.readStream.format("kafka").options(**options).load()


def decode_json(df: DataFrame, schema: T.StructType, value: str = "value", envelope: bool = False) -> DataFrame:
    """Decode JSON text into columns; ``envelope`` expects ``{schema, payload}`` around the row.

    Text that is not JSON gives null columns and its raw form in ``_corrupt_record``.
    """
    wire = T.StructType([T.StructField("payload", schema)]) if envelope else schema
    wire = T.StructType([*wire.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = df.withColumn("_parsed", F.from_json(F.col(value), wire, {"mode": "PERMISSIVE"}))
    row = "_parsed.payload" if envelope else "_parsed"
    others = [c for c in df.columns if c != value]
    return parsed.select(
        *others, *[F.col(f"{row}.{f}").alias(f) for f in schema.names], F.col("_parsed._corrupt_record")
    )


def decode_avro(df: DataFrame, avro_schema: str, value: str = "value") -> DataFrame:
    """Decode registry-framed Avro: a 5-byte header, then the record (needs the Avro module on the cluster)."""
    from pyspark.sql.avro.functions import from_avro

    body = F.expr(f"substring({value}, 6)")
    others = [c for c in df.columns if c != value]
    return df.withColumn("_parsed", from_avro(body, avro_schema)).select(*others, "_parsed.*")
