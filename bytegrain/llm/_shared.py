"""Shared storage, table checkpoints and bounded Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.operators.stored import shared_folder


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/bytegrain/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: later jobs neither recompute it nor depend on one executor."""
    return _stored(df, new_path(df.sparkSession, what))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Stored tables that an operator needs until its result is stored; drop() deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        self.paths.append(new_path(self.spark, what))
        return _stored(df, self.paths[-1])

    def drop(self, keep: int = 0) -> None:
        """Deletes all tables but the `keep` latest."""
        old, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for path in old:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of at most so many rows, so that batches of long texts fit in a Python worker."""
    now = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    if int(now) <= 0 or int(now) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a table's size, or the bytes of its texts where it knows none; it only sizes sketches and partitions, results do not depend on it."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 60:
        return known
    return df.agg(*(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary"))).first()[0] or 1


def partitions_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Enough partitions for df's estimated bytes, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1_000_000, estimated_bytes(df) // bytes_each))
