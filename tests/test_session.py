from __future__ import annotations

import pytest

from lakestream.session import sibling, stream_session, work_dir


class Fake:
    """A session without a checkpoint folder, as far as ``work_dir`` looks at it."""

    def __init__(self, master):
        self.master, self.applicationId, self.folder = master, f"app-{master}", None
        self.sparkContext = self.conf = self

    def get(self, key, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_work_folders_are_fresh_and_under_the_shared_folder(spark):
    first, second = work_dir(spark, "x"), work_dir(spark, "x")
    assert first != second
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert shared is None or first.startswith(shared)


def test_only_local_sessions_fall_back_to_a_temporary_folder():
    local = Fake("local[2]")
    base = work_dir(local, "x").split("/lakestream/")[0]
    assert local.folder is None and work_dir(local, "y").startswith(base)
    with pytest.raises(ValueError):
        work_dir(Fake("yarn"), "x")


def test_siblings_share_settings_and_not_views(spark):
    spark.range(3).createOrReplaceTempView("only_here")
    other = sibling(spark)
    assert other.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert stream_session(spark).conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert not other.catalog.tableExists("only_here")
    spark.catalog.dropTempView("only_here")


def test_stream_session_leaves_the_callers_settings_alone(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    assert "RocksDB" in stream_session(spark).conf.get(key)
    assert spark.conf.get(key) == before
