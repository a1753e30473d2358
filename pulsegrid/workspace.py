"""Intermediate tables in the folder all executors share.

Multi-pass operators (tree levels, zero fill over observed keys) write the
small table they re-read instead of recomputing it from the raw facts. The
table survives the loss of any executor and is read back column by column.

A table lives until its scope ends. Operators open a scope of their own for
what they alone read and hand on the rest; a caller opens one around a query or
stage and its action. Without any scope a table lives as long as the application.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import urllib.parse
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_apps: set[str] = set()
_innermost: ContextVar[Scope | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a ``local`` master, where driver and executors are one process, may
    fall back to a folder of this machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if sc.master.partition("[")[0] != "local":
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that every executor can reach"
        )
    if sc.applicationId not in _local_dirs:
        path = tempfile.mkdtemp(prefix="pulsegrid-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local_dirs[sc.applicationId] = path
    return _local_dirs[sc.applicationId]


def app_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/pulsegrid/{spark.sparkContext.applicationId}"


class Scope:
    """Tables and kept frames that go together."""

    def __init__(self, outer: Scope | None):
        self.outer = outer
        self.paths: list[str] = []
        self.frames: list[tuple[DataFrame, bool]] = []  # and whether this scope has to release it

    def keep(self, df: DataFrame) -> DataFrame:
        """Hand a table of this scope, or a frame kept on disk, on to the scope around it."""
        path = getattr(df, "_table_path", None)
        if path in self.paths:
            self.paths.remove(path)
            if self.outer:
                self.outer.paths.append(path)
        elif any(f is df for f, _ in self.frames):
            # Spark keeps a plan once, so its other frames go along
            handed = [f.sameSemantics(df) for f, _ in self.frames]
            if self.outer:
                self.outer.frames += [f for f, goes in zip(self.frames, handed) if goes]
            self.frames = [f for f, goes in zip(self.frames, handed) if not goes]
        else:
            raise ValueError("not a table of this scope")
        return df

    def end(self, spark: SparkSession) -> None:
        for frame, ours in self.frames:
            if ours:
                frame.unpersist()
        for path in self.paths:
            delete(spark, path)
        self.paths, self.frames = [], []


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Delete the tables made inside when the block ends, also by an error.

    What reads them must have run by then; ``keep`` excepts a table.
    """
    inner = Scope(_innermost.get())
    token = _innermost.set(inner)
    try:
        yield inner
    finally:
        _innermost.reset(token)
        inner.end(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder, of the innermost scope."""
    app = spark.sparkContext.applicationId
    if app not in _apps:
        _apps.add(app)
        atexit.register(_clear_at_exit, spark, app_dir(spark))
    path = f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if inner := _innermost.get():
        inner.paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._table_path = path
    return table


def kept(df: DataFrame, level: StorageLevel) -> DataFrame:
    """Persist a frame and register it with the innermost scope, which releases it.

    Spark keeps equal plans once: one that is kept already is used as it is and stays with whoever kept it.
    """
    now = df.storageLevel
    ours = not (now.useDisk or now.useMemory)
    if ours:
        df.persist(level)
    if inner := _innermost.get():
        inner.frames.append((df, ours))
    return df


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clear_at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session ended before the interpreter: a local folder goes all the same
        parts = urllib.parse.urlsplit(path)
        if parts.scheme in ("", "file"):
            shutil.rmtree(parts.path, ignore_errors=True)
        else:
            warnings.warn(f"intermediate tables are left in {path}", stacklevel=1)


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table this application wrote."""
    delete(spark, app_dir(spark))
