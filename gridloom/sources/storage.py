"""Intermediate tables in the folder that driver and executors share.

Every such table goes below the folder that the session names in ``spark.checkpoint.dir``; the next
job reads committed files, so a lost executor costs the re-run of its own tasks and never of
the whole lineage. Tables stay until their reader is done with them: run a query inside :func:`scratch` to put
all of its tables below one folder, and :func:`drop` that folder once the result is written.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_below: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = path = tempfile.mkdtemp(prefix="spark-gridloom-")
        pid = os.getpid()
        atexit.register(lambda: pid == os.getpid() and shutil.rmtree(path, ignore_errors=True))
    return _own[app]


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path that nothing has been written to, inside the current scratch folder if there is one."""
    return f"{_below.get() or shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write ``df`` and return a scan of it: cuts lineage, and survives lost executors.

    The shuffle files of the write go with it; else those of an iteration's rounds add up until the driver collects its garbage."""
    path = path or new_folder(df.sparkSession, tag)
    with _shuffles_dropped(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """All tables that are saved inside go below one new folder, whose path comes back."""
    token = _below.set(new_folder(spark, "scratch"))
    try:
        yield _below.get()
    finally:
        _below.reset(token)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder on whatever store it is; DataFrames over its tables can't be read any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
