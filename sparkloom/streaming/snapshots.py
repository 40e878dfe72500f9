"""Immutable snapshots of a table: stage, validate, activate, roll back. The active one is named by a pointer table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """Generations of one table under a root folder; activations are appended, never overwritten."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/activations")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("seq long, generation string").json(f"{self.root}/activations")

    def stage(self, df: DataFrame, generation: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{generation}")
        return self.read(generation)

    def read(self, generation: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{generation}")

    def active(self) -> str | None:
        log = self._log()
        row = log.orderBy(F.desc("seq")).first() if log is not None else None
        return row["generation"] if row else None

    def activate(self, generation: str, valid: Callable[[DataFrame], bool] = lambda df: True) -> None:
        """Make a staged generation the active one, if it passes; otherwise nothing changes."""
        if not valid(self.read(generation)):
            raise ValueError(f"generation {generation} is not valid")
        log = self._log()
        seq = (log.agg(F.max("seq")).first()[0] or 0) + 1 if log is not None else 1
        self.spark.range(1).select(F.lit(seq).cast("long").alias("seq"), F.lit(generation).alias("generation")).write.mode("append").json(f"{self.root}/activations")

    def rollback(self) -> str | None:
        """Activate what was active before."""
        log = self._log()
        rows = log.orderBy(F.desc("seq")).limit(2).collect() if log is not None else []
        if len(rows) < 2:
            raise ValueError("nothing to roll back to")
        self.activate(rows[1]["generation"])
        return rows[1]["generation"]
