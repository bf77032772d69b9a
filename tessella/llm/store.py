"""Tables that cut lineage: parquet in the folder every executor shares.

A table lives until its reader is done: those stashed inside a `scope` are deleted at the scope's end, but for the one
it keeps. What then is left (results that the caller may still read) goes when the session's JVM ends.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Rows of ids or hashes (two longs each) up to which a side may be broadcast: 16 MB at most.
BROADCAST_ROWS = 1_000_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folder of each application.
_folders: dict[str, str] = {}


class _Open(threading.local):
    """Open scopes of a thread, innermost last: the paths that go with each."""

    def __init__(self):
        self.scopes: list[list[str]] = []


_open = _Open()


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, or under SparkContext's own checkpoint directory.

    Where neither is set, a local session makes a temporary folder of its own; a cluster has no folder that could be
    guessed to be shared, so there it is an error.
    """
    sc = spark.sparkContext
    got = _folders.get(sc.applicationId)
    if got:
        return got
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        sc.setCheckpointDir(base)
    got = f"{base.rstrip('/')}/tessella/{sc.applicationId}-{uuid.uuid4().hex[:8]}"
    p, fs = _path(spark, got)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    _folders[sc.applicationId] = got
    return got


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table or a folder of files, which goes with the scope it is asked for in."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open.scopes:
        _open.scopes[-1].append(path)
    return path


def stash(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once and read it back, so that later steps survive lost executors without recomputing it.

    The shuffle files behind it are removed once it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete paths, in the scopes and on disk."""
    for path in paths:
        p, fs = _path(spark, path)
        fs.delete(p, True)
        for s in _open.scopes:
            if path in s:
                s.remove(path)


def discard(*frames: DataFrame | None) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            remove(df.sparkSession, path)
            df._stash_path = None


class Scope:
    """Tables of one operator or stage."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark, self.paths = spark, paths

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Write the scope's result; it outlives the scope, in the one around where there is one."""
        out = stash(df, name)
        self.keep(out)
        return out

    def keep(self, df: DataFrame) -> None:
        """Let a table outlive the scope."""
        self.paths.remove(df._stash_path)
        if len(_open.scopes) > 1:
            _open.scopes[-2].append(df._stash_path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Delete at its end what is stashed inside, but for the result."""
    paths: list[str] = []
    _open.scopes.append(paths)
    try:
        yield Scope(spark, paths)
    finally:
        remove(spark, *list(paths))
        _open.scopes.pop()


def scoped(name: str):
    """For functions of a DataFrame: their tables go when the result is written, as a table of this name."""

    def wrap(f):
        @wraps(f)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            with scope(docs.sparkSession) as tables:
                return tables.result(f(docs, *args, **kwargs), name)

        return run

    return wrap
