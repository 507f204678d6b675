"""Entries: rows of (logical_name, uncompressed_size, content), from a directory tree or a table."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.errors import EmptyArchive, InvalidPath

SCHEMA = "logical_name string, uncompressed_size long, content binary"


def list_tree(root: str) -> list[tuple[str, str, int]]:
    """path, logical name and size of each regular file, by name in byte order. Hidden names, and all below hidden folders, are left out; links are not followed."""
    if not os.path.isdir(root):
        raise InvalidPath(root)
    found, todo = [], [(root, "")]
    while todo:
        folder, prefix = todo.pop()
        with os.scandir(folder) as it:
            for e in it:
                if e.name.startswith("."):
                    continue
                name = prefix + os.fsencode(e.name).decode("utf-8", "replace")
                if e.is_dir(follow_symlinks=False):
                    todo.append((e.path, name + "/"))
                elif e.is_file(follow_symlinks=False):
                    found.append((e.path, name, e.stat(follow_symlinks=False).st_size))
    return sorted(found, key=lambda x: x[1].encode())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with open(path, "rb") as f:
                content = f.read()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())], names=["logical_name", "uncompressed_size", "content"])


def from_tree(spark: SparkSession, root: str) -> DataFrame:
    """Entries of a directory that driver and executors share. Spark's own binaryFile source drops empty files and names that begin with _; this keeps them.

    The driver lists names only; executors read, files of about 32 MB together in a task.
    """
    files = list_tree(root)
    if not files:
        raise EmptyArchive(root)
    parts = min(len(files), max(spark.sparkContext.defaultParallelism, sum(n for _, _, n in files) >> 25))
    rows = spark.createDataFrame([(p, n) for p, n, _ in files], "path string, name string").repartition(max(1, parts))
    return rows.mapInArrow(_read, SCHEMA)


def from_table(table: DataFrame, key: str | list[str], payload: str) -> DataFrame:
    """A table's text (or binary) column as entries; the key, joined by `/`, is the name. A null payload is empty."""
    keys = [key] if isinstance(key, str) else key
    kind = dict(table.dtypes)[payload]
    content = F.col(payload) if kind == "binary" else F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    return table.select(F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("logical_name"), F.coalesce(content, F.lit(b"")).alias("content")).select("logical_name", F.octet_length("content").cast("long").alias("uncompressed_size"), "content")


def from_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Entries by Spark's binaryFile source, for stores that only Spark reads (empty and hidden files are not in it)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("logical_name"), F.col("length").alias("uncompressed_size"), "content")
