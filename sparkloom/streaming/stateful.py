"""Streaming forms of the event operators. A run over a bounded source gives what the batch form gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.sources.shared import shared_dir


def read_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A table file of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet*").option("recursiveFileLookup", "true").parquet(folder)


def tumbling_counts(events: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by window and keys; windows close once the watermark has passed them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def deduplicated(events: DataFrame, ts: str, key: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def running_state(events: DataFrame, key: str, state_schema: str, out_schema: str, fold: Callable, mode: str = "update") -> DataFrame:
    """A state per key, folded over its rows batch by batch: fold(key, rows, state or None) -> (state, output rows)."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        rows = pd.concat(list(frames), ignore_index=True)
        following, out = fold(k, rows, state.get if state.exists else None)
        state.update(following)
        yield out

    return events.groupBy(key).applyInPandasWithState(run, out_schema, state_schema, mode, GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Process all that is there, exactly once per checkpoint: a batch that fails is offered again."""
    where = checkpoint or shared_dir(stream.sparkSession) + "/checkpoint"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
