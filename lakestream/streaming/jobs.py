"""SQL script jobs, user-code jobs and their restart modes."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lakestream.session import sibling, stream_session
from lakestream.streaming.sink import run_available

#: Names a script reads, each with what loads it into the job's session.
Tables = dict[str, Callable[[SparkSession], DataFrame]]

RESTART_MODES = ("stateless", "savepoint", "last-state")


def statements(script: str) -> list[str]:
    """The statements of a script, cut at semicolons outside quotes and comments; a ``BEGIN .. END`` block is one."""
    if re.match(r"(?is)\s*begin\b.*\bend\s*;?\s*$", script):
        return [script.strip().rstrip(";")]
    token = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'"`;/-]+|.""", re.S)
    parts = [""]
    for piece in token.findall(script):
        if piece == ";":
            parts.append("")
        elif not piece.startswith(("--", "/*")):
            parts[-1] += piece
    return [part.strip() for part in parts if part.strip()]


def run_script(session: SparkSession, script: str, params: dict[str, str] | None = None) -> DataFrame:
    """Run the statements one after the other and return the result of the last; they see ``params`` as variables."""
    for name, value in (params or {}).items():
        session.sql(f"DECLARE OR REPLACE VARIABLE `{name}` STRING")
        session.sql(f"SET VARIABLE `{name}` = :value", args={"value": value})
    result = None
    for statement in statements(script):
        result = session.sql(statement)
    if result is None:
        raise ValueError("the script has no statement")
    return result


def job_session(session: SparkSession, tables: Tables) -> SparkSession:
    for name, load in tables.items():
        load(session).createOrReplaceTempView(name)
    return session


def run_sql_job(
    spark: SparkSession, script: str, params: dict[str, str] | None = None, tables: Tables | None = None
) -> DataFrame:
    """Run a script over ``tables`` in a session of its own, so that two jobs may use the same names.

    The script is ``a; b; c`` or one ``BEGIN ... END`` block for Spark's SQL scripting.
    """
    return run_script(job_session(sibling(spark), tables or {}), script, params)


def run_sql_stream(
    spark: SparkSession,
    script: str,
    topics: Tables,
    commit: Callable[[DataFrame, int], None],
    checkpoint: str,
    params: dict[str, str] | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Run a script over streams: its last statement's rows go to ``commit``, batch by batch.

    ``topics`` give a stream for each name the script reads. Processes what is there and stops.
    """
    session = job_session(stream_session(spark), topics)
    return run_available(run_script(session, script, params), commit, checkpoint, mode)


def run_code_job(
    spark: SparkSession, entry: str | Callable[[SparkSession, dict[str, str]], DataFrame], params: dict[str, str] | None = None
) -> DataFrame:
    """Run a user's entry point, ``module:function`` or the function itself, in a session of its own."""
    if isinstance(entry, str):
        module, _, name = entry.partition(":")
        entry = getattr(importlib.import_module(module), name or "main", None)
        if not callable(entry):
            raise ValueError(f"no entry point {name or 'main'} in {module}")
    result = entry(sibling(spark), dict(params or {}))
    if not isinstance(result, DataFrame):
        raise TypeError("an entry point returns a DataFrame")
    return result


def checkpoint_for(
    spark: SparkSession, mode: str, checkpoint: str, fresh: str, savepoint: str | None = None
) -> str:
    """Checkpoint folder a restarted query should use.

    ``last-state`` continues, ``stateless`` starts over in ``fresh``, ``savepoint`` continues from a copy of a
    named folder.
    """
    if mode == "last-state":
        return checkpoint
    if mode == "stateless":
        return fresh
    if mode != "savepoint":
        raise ValueError(f"unknown restart mode: {mode}")
    if savepoint is None:
        raise ValueError("savepoint mode needs a savepoint folder")
    copy_folder(spark, savepoint, fresh)
    return fresh


def copy_folder(spark: SparkSession, source: str, target: str) -> None:
    """Copy a checkpoint folder within the shared file system."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    src, dst = hadoop.fs.Path(source), hadoop.fs.Path(target)
    if not hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, dst.getFileSystem(conf), dst, False, conf):
        raise OSError(f"could not copy {source} to {target}")
