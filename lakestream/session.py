"""Session helpers: build a session, read a test table, find the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lakestream", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session for local runs; on a cluster, spark-submit supplies master and sizes."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table. Time arithmetic below assumes UTC, so the zone is pinned here."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="lakestream-")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder every executor can reach, under ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local path would
    lose checkpoints and tables together with the executor.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = _local_folder(context.applicationId)
    return f"{base.rstrip('/')}/lakestream/{label}-{uuid.uuid4().hex}"


def sibling(spark: SparkSession) -> SparkSession:
    """A session on the same cluster with the caller's SQL settings and views and variables of its own."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def stream_session(spark: SparkSession) -> SparkSession:
    """A sibling session with RocksDB state and changelog checkpoints.

    The state settings are read when a query starts; a sibling keeps them off the caller's session. Every
    shuffle partition of a stateful query is a state store committed per batch; their number is the caller's setting.
    """
    session = sibling(spark)
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return session
