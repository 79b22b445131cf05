"""Bad records: dead-letter split, fail-fast, retry, and the counts of both."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Result = TypeVar("Result")

# Longest pause and total time of a retried write, in seconds.
RETRY_MAX_DELAY = 60.0
RETRY_TOTAL = 300.0


@dataclass(frozen=True)
class Check:
    """A condition that makes a record bad, with the context its dead letter carries."""

    stage: str
    error_class: str
    message: str
    failed: Column


def tag_errors(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Add ``error_stage``, ``error_class`` and ``error_message`` of the first failed check; null for good rows."""

    def first(value_of) -> Column:
        chain = F
        for check in checks:
            chain = chain.when(F.coalesce(check.failed, F.lit(False)), F.lit(value_of(check)))
        return chain

    return df.withColumns(
        {
            "error_stage": first(lambda c: c.stage),
            "error_class": first(lambda c: c.error_class),
            "error_message": first(lambda c: c.message),
        }
    )


def split_errors(
    df: DataFrame, checks: Sequence[Check], connector: str, raw: Sequence[str], dlq: Column
) -> tuple[DataFrame, DataFrame]:
    """Good records, and dead letters made of the ``raw`` columns, their context and the ``dlq`` topic.

    Both are filters over one projection; nothing is shuffled or held in memory.
    """
    tagged = tag_errors(df, checks)
    context = ("error_stage", "error_class", "error_message")
    good = tagged.filter(F.col("error_class").isNull()).drop(*context)
    bad = tagged.filter(F.col("error_class").isNotNull())
    return good, bad.select(*raw, F.lit(connector).alias("connector"), dlq.alias("dlq_topic"), *context)


def fail_fast(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Stop the job at the first bad record: the error is raised inside the plan.

    The guard sits in the filter, so it is evaluated for every row whatever columns are read later.
    """
    chain = F
    for check in checks:
        text = F.concat(F.lit(f"{check.error_class}: {check.message}"))
        chain = chain.when(F.coalesce(check.failed, F.lit(False)), F.raise_error(text).cast("boolean"))
    return df.filter(chain.otherwise(F.lit(True)))


def is_permanent(error: Exception) -> bool:
    """Errors that come back on every attempt: a query that cannot be analysed, a value or record that is rejected."""
    return isinstance(error, (AnalysisException, ValueError)) or "USER_RAISED_EXCEPTION" in str(error)


def retry(
    write: Callable[[], Result],
    max_delay: float = RETRY_MAX_DELAY,
    total: float = RETRY_TOTAL,
    first_delay: float = 1.0,
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.monotonic,
) -> Result:
    """Run a batch write again after a failure, pausing longer each time, until ``total`` seconds are used.

    Permanent errors are raised at once.
    """
    deadline = clock() + total
    delay = first_delay
    while True:
        try:
            return write()
        except Exception as error:
            if is_permanent(error) or clock() + delay > deadline:
                raise
            sleep(delay)
            delay = min(delay * 2, max_delay)


def sink_metrics(df: DataFrame, connector: str, task: str, commit: str, target: str) -> DataFrame:
    """Totals per connector and task of tagged records (see :func:`tag_errors`)."""
    bad = F.col("error_class").isNotNull()
    routed = ~bad & F.col(target).isNotNull()
    return df.groupBy(connector, task).agg(
        F.count_if(bad).alias("total_record_errors"),
        F.count_if(bad).alias("deadletterqueue_produce_requests"),
        F.count_if(routed).alias("sink_record_send_total"),
        F.count_if(~bad & F.col(target).isNull()).alias("unrouted_total"),
        F.countDistinct(commit).alias("offset_commit_completion_total"),
    )


def worker_counts(df: DataFrame, worker: str, connector: str, task: str) -> DataFrame:
    """Connectors and tasks per worker."""
    return df.groupBy(worker).agg(
        F.countDistinct(connector).alias("connector_count"), F.countDistinct(connector, task).alias("task_count")
    )
