"""Tables that cut lineage, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from bytegrain.errors import SharedFolderMissing


def qualified(spark: SparkSession, path: str) -> str:
    """path with its file system, as Spark resolves it, in the form that other readers take too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file:///" + full.removeprefix("file:").lstrip("/") if full.startswith("file:") else full


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a local one is set only where none is named and the session runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise SharedFolderMissing("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="bytegrain-")
        spark.conf.set("spark.checkpoint.dir", found)
    return qualified(spark, found.rstrip("/"))


#: Paths that the innermost scratch() will delete.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def new_path(spark: SparkSession, what: str) -> str:
    """A name in the shared folder that nothing has yet; what is written there is deleted at the end of the scratch() that it was asked for in."""
    path = f"{shared_folder(spark)}/bytegrain/{what}-{uuid.uuid4().hex}"
    if (held := _scratch.get()) is not None:
        held.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """For work whose result is stored under a path from outside: tables and folders made within are deleted at the end, and no lazy rows may read them later."""
    token = _scratch.set(held := [])
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in held:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: With it, Spark deletes an action's shuffle files at the action's end; else they stay until the driver's JVM happens to collect garbage.
_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """For actions whose shuffle files nothing reads again: they go with the action."""
    before = spark.conf.get(_SHUFFLES, None)
    spark.conf.set(_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES)
        else:
            spark.conf.set(_SHUFFLES, before)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as a Parquet table and read again."""
    spark, path = df.sparkSession, path or new_path(df.sparkSession, "table")
    with shuffles_deleted(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
