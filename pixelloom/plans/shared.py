"""Cutting lineage: tables written into the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship(module: str) -> None:
    """Pickle what a module defines by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, an own folder if driver and tasks are one process; on a cluster, whose
    executors would not see it, an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pixelloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """The address of a new folder in the shared one, for files that tasks write themselves; it goes when the JVM ends."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return re.sub(r"^file:/+", "file:///", str(store.makeQualified(path).toString()))


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written and read again; executors that are lost later don't matter. The table goes by
    discard(), or when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    if _scopes:
        _scopes[-1].append(table)
    return table


#: Tables stored within each settled() that is under way, the innermost last.
_scopes: list[list[DataFrame]] = []


def settled(build: Callable[[], DataFrame], name: str = "step") -> DataFrame:
    """What build() gives, stored; the tables that it stored on the way are deleted."""
    _scopes.append([])
    try:
        table = stored(build(), name)
    finally:
        inner = _scopes.pop()
    discard(*(t for t in inner if t is not table))
    if _scopes:
        _scopes[-1].append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave, once nothing reads them any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs of this thread within the block can be cancelled by cancel(), from any thread."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops the jobs with a tag, and streaming queries of that name; what they have written so far stays out of any table."""
    spark.sparkContext.cancelJobsWithTag(tag)
    for q in spark.streams.active:
        if q.name == tag:
            q.stop()
