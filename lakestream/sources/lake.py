"""Lake tables as partitioned Parquet.

A table is a folder: ``commit=<n>/`` holds the rows of batch *n*, ``run=<n>/`` what some commits up to *n* were merged
into, ``base=<n>/`` all up to *n*, and ``_log/`` one small file per finished commit, run or base, written last, with the
table's schema as of then. Readers go by the log, so a commit is seen whole or not at all, an empty or evolved table
reads without looking into files, and a commit that is already in the log, or merged, is a replay and changes nothing.
An upsert commits the latest row per key of its batch only (cost of the batch, not of the table), and readers keep the
latest row per key over base, runs and newer commits.

Merging is paid for by what came in: :func:`fold_when` merges gathered commits into a run together with the older runs,
and at last the base, that are not much larger than what is merged already. So a row is rewritten as often as the
table has doubled since it came, and runs number the logarithm of the table.

With a catalog that supports ``MERGE INTO`` use :func:`merge_into` instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestream.operators.evolution import align, evolve, force_optional
from lakestream.operators.latest import identity, latest_per_key, upsert_small
from lakestream.operators.ordered import null_safe_join

COMMIT = "commit"
#: Commits a sink lets gather before it merges them.
FOLD_EVERY = 16
#: An older run, or the base, is merged along while it is at most so many times as large as what is merged.
SHARE = 2


@dataclass(frozen=True)
class TableLog:
    """Merged parts (what they follow, and their last commit), finished commits, and the newest schema.

    A base follows nothing, which is -1.
    """

    parts: tuple[tuple[int, int], ...]
    commits: tuple[int, ...]
    schema: T.StructType | None

    def chain(self, upto: int | None = None) -> list[tuple[int, int]]:
        """The parts in use, oldest first: each follows the one before it."""
        known, out = {}, []
        for low, last in self.parts:
            if upto is None or last <= upto:
                known[last] = min(low, known.get(last, low))
        last = max(known, default=-1)
        while last >= 0:
            out.append((known[last], last))
            last = known[last]
        return out[::-1]

    @property
    def base(self) -> int | None:
        chain = self.chain()
        return chain[0][1] if chain and chain[0][0] < 0 else None

    def newer(self, upto: int | None = None) -> list[int]:
        """Commits beyond the parts in use."""
        chain = self.chain(upto)
        low = chain[-1][1] if chain else -1
        return [n for n in self.commits if n > low and (upto is None or n <= upto)]

    def has(self, commit: int) -> bool:
        return commit in self.commits or any(low < commit <= last for low, last in self.parts)


def _name(low: int, last: int) -> str:
    return f"base={last}" if low < 0 else f"run={last}"


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _file_system(spark, path)
    return fs.exists(jpath)


def read_table_log(spark: SparkSession, path: str) -> TableLog:
    """One listing of the log folder and the newest file in it; there are few, since merging clears older ones."""
    fs, folder = _file_system(spark, f"{path}/_log")
    if not fs.exists(folder):
        return TableLog((), (), None)
    found = [re.fullmatch(r"(?:(\d+)-)?(\d+)\.(commit|run|base)", s.getPath().getName()) for s in fs.listStatus(folder)]
    found = [m for m in found if m]
    commits = sorted(int(m[2]) for m in found if m[3] == "commit")
    parts = sorted((-1 if m[3] == "base" else int(m[1]), int(m[2])) for m in found if m[3] != "commit")
    # of a commit and what it was merged into, whichever: they have one schema
    newest = max(found, key=lambda m: (int(m[2]), m[3]), default=None)
    schema = None
    if newest:
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_log/{newest[0]}"))
        try:
            schema = T.StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()
    return TableLog(tuple(parts), tuple(commits), schema)


def _mark(spark: SparkSession, path: str, name: str, schema: T.StructType) -> None:
    """Make a commit or base visible: its log file appears by a rename."""
    fs, target = _file_system(spark, f"{path}/_log/{name}")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_log/_{name}")
    out = fs.create(draft, True)
    out.write(bytearray(schema.json().encode()))
    out.close()
    if not fs.rename(draft, target):
        raise OSError(f"could not finish {path}/{name}")


def write_partitioned(df: DataFrame, folder: str, partition_by: str | None) -> None:
    """The rebalance hint lets adaptive execution split a partition value that holds most rows and merge tiny ones."""
    if partition_by:
        df.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(folder)
    else:
        df.write.mode("overwrite").parquet(folder)


def append(df: DataFrame, path: str, commit: int, partition_by: str | None = None) -> T.StructType:
    """Write all rows as one commit and return the table's schema after it; creates the table when it is absent.

    The schema grows by the batch's new columns and wider types; a type the table cannot hold raises
    ``IncompatibleSchema`` before anything is written. A replayed commit changes nothing.
    """
    spark = df.sparkSession
    log = read_table_log(spark, path)
    if log.has(commit):
        return log.schema
    schema = force_optional(df.schema) if log.schema is None else evolve(log.schema, df.schema)
    write_partitioned(align(df, schema), f"{path}/{COMMIT}={commit}", partition_by)
    _mark(spark, path, f"{commit}.commit", schema)
    return schema


def upsert_commit(
    batch: DataFrame,
    path: str,
    commit: int,
    ids: Sequence[str],
    order: Sequence[str],
    partition_by: str | None = None,
    scope: str = "global",
) -> None:
    """Write the latest row per key of a batch as one commit."""
    append(latest_per_key(batch, identity(ids, partition_by, scope), order), path, commit, partition_by)


def _commits(spark: SparkSession, path: str, numbers: Sequence[int], schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(COMMIT, T.LongType(), True)])
    if not numbers:
        return spark.createDataFrame([], full)
    folders = [f"{path}/{COMMIT}={n}" for n in numbers]
    return spark.read.schema(full).option("basePath", path).parquet(*folders)


def _part(spark: SparkSession, path: str, part: tuple[int, int], schema: T.StructType) -> DataFrame:
    rows = spark.read.schema(schema).parquet(f"{path}/{_name(*part)}")
    return rows.withColumn(COMMIT, F.lit(part[1]).cast("long"))


def _schema_of(log: TableLog, path: str) -> T.StructType:
    if log.schema is None:
        raise FileNotFoundError(f"no finished commit in {path}")
    return log.schema


def _rows(
    spark: SparkSession, path: str, schema: T.StructType, parts: Sequence[tuple[int, int]], commits: Sequence[int]
) -> DataFrame:
    rows = _commits(spark, path, commits, schema)
    for part in parts:
        rows = rows.unionByName(_part(spark, path, part, schema))
    return rows


def read_log(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """All committed rows with their commit number; merged ones have the number of their run or base."""
    log = read_table_log(spark, path)
    return _rows(spark, path, _schema_of(log, path), log.chain(upto), log.newer(upto))


def read_upserted(
    spark: SparkSession,
    path: str,
    ids: Sequence[str],
    order: Sequence[str],
    partition_by: str | None = None,
    scope: str = "global",
    upto: int | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Table content: the latest row per key over base and commits, soft deletes included.

    ``only`` holds id values; other keys are dropped before rows are compared. The base is unique by key, so the
    newer commits are joined to it and, while they are small enough to broadcast, the bulk of the table is read
    without a shuffle.
    """

    def wanted(rows: DataFrame) -> DataFrame:
        return rows if only is None else null_safe_join(rows, only.select(*ids), ids, "left_semi")

    log = read_table_log(spark, path)
    schema, chain, numbers = _schema_of(log, path), log.chain(upto), log.newer(upto)
    order, key = [*order, COMMIT], identity(ids, partition_by, scope)
    if not chain or chain[0][0] >= 0:
        return latest_per_key(wanted(_rows(spark, path, schema, chain, numbers)), key, order).drop(COMMIT)
    base, runs = wanted(_part(spark, path, chain[0], schema)), chain[1:]
    if not runs and not numbers:
        return base.drop(COMMIT)
    newer = wanted(_rows(spark, path, schema, runs, numbers))
    return upsert_small(base, newer, ids, order, partition_by, scope).drop(COMMIT)


def _merge(
    spark: SparkSession,
    path: str,
    log: TableLog,
    parts: Sequence[tuple[int, int]],
    ids: Sequence[str],
    order: Sequence[str],
    partition_by: str | None,
    scope: str,
) -> int:
    """Write the newest ``parts`` in use and all newer commits as one part; without ``ids`` every row stays.

    Later commits go on top; a replay of a merged one changes nothing. What the parts before this merge had replaced is
    deleted, so whoever still reads the last state finds its files.
    """
    numbers, schema = log.newer(), _schema_of(log, path)
    last = numbers[-1] if numbers else parts[-1][1]
    chain = log.chain()
    low = parts[0][0] if parts else chain[-1][1] if chain else -1
    if ids and parts and low < 0:
        rows = read_upserted(spark, path, ids, order, partition_by, scope)
    else:
        rows = _rows(spark, path, schema, parts, numbers)
        rows = latest_per_key(rows, identity(ids, partition_by, scope), [*order, COMMIT]) if ids else rows
        rows = rows.drop(COMMIT)
    write_partitioned(rows, f"{path}/{_name(low, last)}", partition_by)
    _mark(spark, path, f"{last}.base" if low < 0 else f"{low}-{last}.run", schema)
    if chain:
        _drop_merged(spark, path, log)
    return last


def fold(
    spark: SparkSession,
    path: str,
    ids: Sequence[str],
    order: Sequence[str],
    partition_by: str | None = None,
    scope: str = "global",
) -> int:
    """Rewrite everything into a new base and return its number, that of the last commit."""
    log = read_table_log(spark, path)
    chain = log.chain()
    if not log.newer() and len(chain) < 2:
        return log.base
    return _merge(spark, path, log, chain, ids, order, partition_by, scope)


def _drop_merged(spark: SparkSession, path: str, log: TableLog) -> None:
    """Delete the commits that parts of ``log`` hold, and parts it did not use any more."""
    fs, folder = _file_system(spark, path)
    to, chain = spark._jvm.org.apache.hadoop.fs.Path, log.chain()
    gone = {f"commit={n}" for n in log.commits if n <= chain[-1][1]} | {f"{n}.commit" for n in log.commits if n <= chain[-1][1]}
    for low, last in set(log.parts) - set(chain):
        gone |= {_name(low, last), f"{last}.base" if low < 0 else f"{low}-{last}.run"}
    for status in [*fs.listStatus(to(f"{path}/_log")), *fs.listStatus(folder)]:
        if status.getPath().getName() in gone:
            fs.delete(status.getPath(), True)


def _size(spark: SparkSession, path: str) -> int:
    fs, jpath = _file_system(spark, path)
    return fs.getContentSummary(jpath).getLength()


def fold_when(
    spark: SparkSession,
    path: str,
    ids: Sequence[str],
    order: Sequence[str],
    partition_by: str | None = None,
    scope: str = "global",
    every: int = FOLD_EVERY,
) -> None:
    """Merge once ``every`` commits have gathered, so a read covers few of them.

    Older runs and the base go along, newest first, while one is at most ``SHARE`` times as large as what is merged so
    far. Without ``ids`` the table only grows, and its rows stay as they are.
    """
    log = read_table_log(spark, path)
    numbers = log.newer()
    if len(numbers) < every:
        return
    chain, along = log.chain(), []
    total = sum(_size(spark, f"{path}/{COMMIT}={n}") for n in numbers)
    while chain and (size := _size(spark, f"{path}/{_name(*chain[-1])}")) <= SHARE * total:
        along.insert(0, chain.pop())
        total += size
    _merge(spark, path, log, along, ids, order, partition_by, scope)


def merge_into(
    spark: SparkSession,
    table: str,
    batch: DataFrame,
    ids: Sequence[str],
    order: Sequence[str],
    partition_by: str | None = None,
    scope: str = "global",
) -> None:
    """Upsert into a catalog table that supports ``MERGE INTO`` (needs such a catalog on the cluster)."""
    keys = identity(ids, partition_by, scope)
    on = " AND ".join(f"t.`{k}` <=> s.`{k}`" for k in keys)
    newer = (
        f"struct({', '.join(f's.`{c}`' for c in order)}) >= struct({', '.join(f't.`{c}`' for c in order)})"
    )
    spark.sql(
        f"MERGE INTO {table} t USING {{batch}} s ON {on} "
        f"WHEN MATCHED AND {newer} THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *",
        batch=latest_per_key(batch, keys, order),
    )
