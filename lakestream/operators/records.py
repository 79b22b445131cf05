"""Record transforms: flatten change events, handle deletes and tombstones, route topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestream.functions.naming import route_topic

DELETE_MODES = ("none", "rewrite", "drop")
META_FIELDS = ("op", "source.ts_ms")


def drop_tombstones(df: DataFrame, value: str = "value") -> DataFrame:
    return df.filter(F.col(value).isNotNull())


def meta_column(field: str) -> str:
    """``source.ts_ms`` becomes ``__source_ts_ms``."""
    return "__" + field.replace(".", "_")


def meta_headers(value: str = "value", fields: tuple[str, ...] = META_FIELDS) -> Column:
    """The metadata fields as an array of key/value headers."""
    return F.array(
        *[
            F.struct(F.lit(meta_column(f)).alias("key"), F.col(f"{value}.{f}").cast("string").alias("value"))
            for f in fields
        ]
    )


def unwrap(
    df: DataFrame,
    delete_mode: str = "rewrite",
    add_fields: tuple[str, ...] = META_FIELDS,
    tombstones: str = "drop",
    headers: bool = False,
    value: str = "value",
) -> DataFrame:
    """Flatten the change envelope in column ``value``; other columns stay.

    ``rewrite`` keeps a delete as its before image with ``__deleted = 'true'``; ``drop`` removes it;
    ``none`` passes it on with every row column null. An unknown mode means ``rewrite``.
    """
    mode = delete_mode if delete_mode in DELETE_MODES else "rewrite"
    if tombstones == "drop":
        df = drop_tombstones(df, value)
    deleted = F.coalesce(F.col(f"{value}.op") == "d", F.lit(False))
    if mode == "drop":
        df = df.filter(~deleted)
    image = F.col(f"{value}.after")
    if mode == "rewrite":
        image = F.when(deleted, F.col(f"{value}.before")).otherwise(image)

    fields = df.schema[value].dataType["after"].dataType.names
    row = [image.getField(f).alias(f) for f in fields]
    meta = [F.col(f"{value}.{f}").alias(meta_column(f)) for f in add_fields]
    if headers:
        meta.append(meta_headers(value, add_fields).alias("headers"))
    if mode == "rewrite":
        flag = F.when(F.col(value).isNotNull(), F.when(deleted, "true").otherwise("false"))
        meta.append(flag.alias("__deleted"))
    kept = [c for c in df.columns if c != value and c not in fields]
    return df.select(*kept, *row, *meta)


def route(df: DataFrame, regex: str, replacement: str, topic: str = "topic") -> DataFrame:
    return df.withColumn(topic, route_topic(F.col(topic), regex, replacement))


def unwrap_and_route(df: DataFrame, regex: str, replacement: str, **unwrap_options) -> DataFrame:
    """The fixed chain: first unwrap, then route."""
    return df.transform(unwrap, **unwrap_options).transform(route, regex, replacement)
