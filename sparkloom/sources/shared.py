"""Tables that cut a lineage, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

MARK = "/loom-"
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under the warehouse.

    A warehouse on one machine's disk is refused unless the session itself runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if root.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root += "/_shared"
    path = f"{root.rstrip('/')}{MARK}{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, and later steps see one fixed result."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete a table written by materialize() that nothing needs any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if MARK in path:
            delete(df.sparkSession, path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the folders handed out inside; what is still listed at the end is deleted."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open.remove(paths)
        for path in paths:
            delete(spark, path)
