"""Topic and table names as column expressions.

Topic: ``[env.]layer.domain[.subdomain...].dataset[_stage]``; table: ``layer.domain_dataset[_stage]``.
Everything here is a plain expression, so names are handled inside the plan, next to the records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layers, processing stages, compatibility per layer, identifier case per database kind.
LAYERS = ("bronze", "silver", "gold")
STAGES = ("raw", "cleaned", "enriched", "denormalized", "aggregated")
LAYER_COMPATIBILITY = {"bronze": "NONE", "silver": "BACKWARD", "gold": "FULL"}
DEFAULT_COMPATIBILITY = "BACKWARD"
LOWER_CASE_KINDS = ("postgres", "mysql")
UPPER_CASE_KINDS = ("db2", "db2as400", "oracle")
DEFAULT_DLQ = "m3.iceberg.dlq"

_STAGED = rf"(?i)^(.+)_({'|'.join(STAGES)})$"


def _text(value: Column | str | None) -> Column:
    """Literal text or a column, with the empty string read as missing."""
    if value is None:
        return F.lit(None).cast("string")
    col = value if isinstance(value, Column) else F.lit(value)
    return F.nullif(col, F.lit(""))


def dataset_of(name: Column) -> Column:
    return F.when(name.rlike(_STAGED), F.regexp_extract(name, _STAGED, 1)).otherwise(name)


def stage_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, _STAGED, 2), F.lit(""))


def with_topic_parts(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Add environment, layer, domain, subdomain, dataset, stage and ``parse_error``.

    A name that cannot be parsed keeps its row: the reason is a value, the parts are null.
    """
    parts, at = F.col("_parts"), F.col("_at")
    size = F.size(parts)

    def is_layer(i: int) -> Column:
        return F.lower(F.get(parts, F.lit(i))).isin(*LAYERS)

    # position of the layer: 0, 1 after an environment, or none
    layer_at = F.when(size < 3, None).when(is_layer(0), 0).when((size >= 4) & is_layer(1), 1)
    error = (
        F.when(F.col(topic).isNull() | (F.trim(F.col(topic)) == ""), "empty topic")
        .when(size < 3, "too few parts")
        .when(at.isNull(), "no layer")
    )
    last = F.when(at.isNotNull(), F.element_at(parts, -1))
    middle = F.slice(parts, at + 3, F.greatest(size - at - 3, F.lit(0)))
    return (
        df.withColumn("_parts", F.split(F.col(topic), r"\."))
        .withColumn("_at", layer_at)
        .withColumns(
            {
                "environment": F.when(at == 1, F.get(parts, F.lit(0))),
                "layer": F.lower(F.get(parts, at)),
                "domain": F.get(parts, at + 1),
                "subdomain": F.when(size - at > 3, F.array_join(middle, ".")),
                "dataset": dataset_of(last),
                "stage": stage_of(last),
                "parse_error": error,
            }
        )
        .drop("_parts", "_at")
    )


def _staged(dataset: Column, stage: Column) -> Column:
    return F.concat_ws("_", dataset, _text(stage))


def topic_name(
    layer: Column,
    domain: Column,
    dataset: Column,
    environment: Column | None = None,
    subdomain: Column | None = None,
    stage: Column | None = None,
) -> Column:
    """Inverse of :func:`with_topic_parts`; null when there is no layer."""
    name = F.concat_ws(
        ".", _text(environment), F.lower(layer), domain, _text(subdomain), _staged(dataset, _text(stage))
    )
    return F.when(layer.isNotNull(), name)


def lake_table(layer: Column, domain: Column, dataset: Column, stage: Column | None = None) -> Column:
    """Table of a topic. Environment and subdomain are not part of it, so topics can collide."""
    return F.concat(F.lower(layer), F.lit("."), F.concat_ws("_", domain, _staged(dataset, _text(stage))))


def dlq_topic(
    topic: Column | None = None, explicit: Column | str | None = None, default: str = DEFAULT_DLQ
) -> Column:
    """An explicit non-default name, else ``{topic}_dlq``, else the default."""
    chosen = F.nullif(_text(explicit), F.lit(default))
    derived = F.concat(_text(topic), F.lit("_dlq"))
    return F.coalesce(chosen, derived, F.lit(default))


def layer_compatibility(layer: Column) -> Column:
    """Default level of a layer; null for a record without one."""
    levels = reduce(
        lambda acc, item: acc.when(F.lower(layer) == item[0], item[1]),
        LAYER_COMPATIBILITY.items(),
        F.when(layer.isNull(), F.lit(None).cast("string")),
    )
    return levels.otherwise(DEFAULT_COMPATIBILITY)


def normalize_table(name: Column, kind: Column) -> Column:
    """Identifier case a database catalog reports: lower, upper or as written."""
    kind = F.lower(kind)
    return (
        F.when(kind.isin(*LOWER_CASE_KINDS), F.lower(name))
        .when(kind.isin(*UPPER_CASE_KINDS), F.upper(name))
        .otherwise(name)
    )


def route_topic(topic: Column, regex: str, replacement: str) -> Column:
    """Rename a topic whose *whole* name matches; other names pass unchanged."""
    return F.regexp_replace(topic, f"^(?:{regex})$", replacement)


def output_topic(
    table: Column, prefix: Column | str, kind: Column, regex: str | None = None, replacement: str | None = None
) -> Column:
    """Topic a captured table is published to: prefix, normalised name, then the route."""
    topic = F.concat_ws(".", _text(prefix), normalize_table(table, kind))
    return route_topic(topic, regex, replacement) if regex and replacement else topic


def topic_prefix(layer: Column, domain: Column, subdomain: Column | None = None, explicit: Column | None = None):
    return F.coalesce(_text(explicit), F.concat_ws(".", F.lower(layer), domain, _text(subdomain)))


def resolve_table(explicit: Column, from_parts: Column, from_topic: Column) -> Column:
    """Explicit destination, else the one built from naming parts, else the one parsed from the topic."""
    return F.coalesce(_text(explicit), from_parts, from_topic)


def value_subject(topic: Column) -> Column:
    return F.concat(topic, F.lit("-value"))
