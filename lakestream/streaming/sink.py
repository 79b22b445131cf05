"""Streams into lake tables: one commit per micro-batch, visible on a fixed interval."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakestream.operators.errors import Check, fail_fast, retry, split_errors
from lakestream.operators.evolution import IncompatibleSchema
from lakestream.operators.routing import route_by_field
from lakestream.sources.cdc import decode_json
from lakestream.sources.lake import FOLD_EVERY, append, fold_when, upsert_commit

# Commit interval of a sink and of the debug sink, in seconds.
COMMIT_INTERVAL = 60
DEBUG_COMMIT_INTERVAL = 10


def start(
    stream: DataFrame,
    commit: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: int | None = COMMIT_INTERVAL,
    mode: str = "append",
) -> StreamingQuery:
    """Run ``commit(batch, batch_id)`` per micro-batch; ``interval=None`` reads what is there and stops.

    A batch replayed after a failure has the same id; a commit that is finished already changes nothing.
    """
    writer = stream.writeStream.outputMode(mode).foreachBatch(commit).option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval} seconds").start()


def run_available(
    stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process everything available now and wait for the end."""
    query = start(stream, commit, checkpoint, interval=None, mode=mode)
    query.awaitTermination()
    return query


def append_to(
    path: str, partition_by: str | None = None, fold_every: int = FOLD_EVERY
) -> Callable[[DataFrame, int], None]:
    """Append each batch as a commit; gathered commits are merged into few larger parts, with the same rows."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        retry(lambda: append(batch, path, batch_id, partition_by))
        fold_when(batch.sparkSession, path, [], [], partition_by, every=fold_every)

    return commit


def upsert_to(
    path: str,
    ids: Sequence[str],
    order: Sequence[str],
    partition_by: str | None = None,
    scope: str = "global",
    dlq_path: str | None = None,
    fold_every: int = FOLD_EVERY,
) -> Callable[[DataFrame, int], None]:
    """Upsert each batch, creating the table, growing its schema, and folding its commits as they gather.

    A batch with a type the table cannot hold goes to ``dlq_path`` as JSON, or fails the query without one.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        try:
            retry(lambda: upsert_commit(batch, path, batch_id, ids, order, partition_by, scope))
        except IncompatibleSchema as error:
            if dlq_path is None:
                raise
            message = str(error)
            retry(lambda: append(schema_letters(batch, message), dlq_path, batch_id))
            return
        fold_when(batch.sparkSession, path, ids, order, partition_by, scope, fold_every)

    return commit


def shifted(commit: Callable[[DataFrame, int], None], by: int) -> Callable[[DataFrame, int], None]:
    """Number batches from ``by`` on: a job restarted without its checkpoint continues after the table's commits."""
    return lambda batch, batch_id: commit(batch, batch_id + by)


def schema_letters(batch: DataFrame, message: str) -> DataFrame:
    """Dead letters of a batch whose schema does not fit: the whole record as JSON, and why."""
    return batch.select(
        F.to_json(F.struct(*batch.columns)).alias("record"),
        F.lit("schema").alias("error_stage"),
        F.lit("IncompatibleSchema").alias("error_class"),
        F.lit(message).alias("error_message"),
    )


def upsert_topics_to(
    folder: str,
    field: str,
    value: str,
    schemas: dict[str, T.StructType],
    ids: Sequence[str],
    order: Sequence[str],
    dlq_path: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """Route records whose targets have schemas of their own: a table per target, ``value`` decoded as it asks.

    No record is lost: one without a target, with a target that has no schema, or with a value that does not
    decode goes to the dead letters (``folder/dead_letters`` unless given) with its raw value and target.
    """
    letters_path = dlq_path or f"{folder}/dead_letters"

    def commit(batch: DataFrame, batch_id: int) -> None:
        routed = route_by_field(batch, field)
        known = F.coalesce(F.col("target").isin(list(schemas)), F.lit(False))
        lost = F.when(F.col("target").isNull(), "NoTarget").otherwise("UnknownTarget")
        letters = routed.filter(~known).select(
            F.col(value).alias("record"), "target", F.lit("route").alias("error_stage"), lost.alias("error_class")
        )
        decoded = {}
        for target, schema in schemas.items():
            here = routed.filter(F.col("target") == target).select(F.col(value).alias("_raw"), F.col(value).alias("_value"))
            decoded[target] = decode_json(here, schema, "_value")
            broken = F.col("_raw").isNull() | F.col("_corrupt_record").isNotNull()
            letters = letters.unionByName(
                decoded[target].filter(broken).select(
                    F.col("_raw").alias("record"),
                    F.lit(target).alias("target"),
                    F.lit("decode").alias("error_stage"),
                    F.lit("BadRecord").alias("error_class"),
                )
            )
        append_to(letters_path)(letters, batch_id)
        for target, schema in schemas.items():
            fine = decoded[target].filter(F.col("_raw").isNotNull() & F.col("_corrupt_record").isNull())
            upsert_to(f"{folder}/{target}", ids, order)(fine.select(*schema.names), batch_id)

    return keeping(commit)


def upsert_routed_to(
    path: str, field: str, ids: Sequence[str], order: Sequence[str]
) -> Callable[[DataFrame, int], None]:
    """Route by a field and upsert: all target tables of a batch are written by one job, a folder per target.

    Every target is a partition of ``path``; records without a target are left out. Targets share one schema; see
    :func:`upsert_topics_to` for targets with their own.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        routed = route_by_field(batch, field).filter(F.col("target").isNotNull())
        retry(lambda: upsert_commit(routed, path, batch_id, ids, order, "target", "partition"))

    return commit


def split_to(
    good: Callable[[DataFrame, int], None],
    dlq_path: str,
    checks: Sequence[Check],
    connector: str,
    raw: Sequence[str],
    dlq: Column,
) -> Callable[[DataFrame, int], None]:
    """Tolerate errors: bad records go to the dead-letter table, the rest to ``good``.

    Kept batches spill to disk and are computed again where an executor is lost.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        rows, letters = split_errors(batch, checks, connector, raw, dlq)
        retry(lambda: append(letters, dlq_path, batch_id))
        good(rows, batch_id)

    return keeping(commit)


def keeping(commit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Keep the batch while a commit reads it more than once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            commit(kept, batch_id)
        finally:
            kept.unpersist()

    return run


def strict_to(good: Callable[[DataFrame, int], None], checks: Sequence[Check]) -> Callable[[DataFrame, int], None]:
    """Tolerate none: the first bad record fails the batch, and with it the query."""
    return lambda batch, batch_id: good(fail_fast(batch, checks), batch_id)
