"""Metric names: from a sample's object name to a metric with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (pattern of the sample name, metric name, group of connector, group of task, group of attribute).
RULES = (
    (
        r"kafka.connect<type=task-error-metrics, connector=(.+), task=(.+)><>(total-record-errors|deadletterqueue-produce-requests)",
        "kafka_connect_task_error_",
        1,
        2,
        3,
    ),
    (
        r"kafka.connect<type=connect-worker-metrics><>(connector-count|task-count)",
        "kafka_connect_worker_",
        None,
        None,
        1,
    ),
    (
        r"kafka.connect<type=sink-task-metrics, connector=(.+), task=(.+)><>(sink-record-send-total|offset-commit-completion-total)",
        "kafka_connect_sink_task_",
        1,
        2,
        3,
    ),
)


def _first_rule(name: Column, value_of) -> Column:
    chain = F
    for rule in RULES:
        chain = chain.when(name.rlike(rule[0]), value_of(rule))
    return chain


def relabel(df: DataFrame, name: str = "name") -> DataFrame:
    """Add ``metric``, ``connector`` and ``task`` by the first rule found in the name; drop samples without one.

    Metric names are lower-cased with unsafe characters replaced; label values are kept as they are.
    """
    col = F.col(name)

    def group(rule, index):
        return F.lit(None).cast("string") if index is None else F.regexp_extract(col, rule[0], index)

    metric = F.lower(_first_rule(col, lambda r: F.concat(F.lit(r[1]), group(r, r[4]))))
    return df.withColumns(
        {
            "metric": F.regexp_replace(metric, "[^a-z0-9_:]", "_"),
            "connector": _first_rule(col, lambda r: group(r, r[2])),
            "task": _first_rule(col, lambda r: group(r, r[3])),
        }
    ).filter(F.col("metric").isNotNull())
