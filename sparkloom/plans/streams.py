"""Streaming queries over the events table, run until all of it is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.registry import query
from sparkloom.sources.shared import shared_dir
from sparkloom.sources.tables import table
from sparkloom.streaming import stateful


def _stream(spark, sf):
    """The events; a watermark needs times with a zone, so they are read as UTC."""
    return stateful.read_stream(spark, sf, "events", table(spark, sf, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf):
    """Daily counts, each batch's totals replacing those of the same windows."""
    folder = shared_dir(spark)
    counts = stateful.tumbling_counts(_stream(spark, sf), "ts", ["event_type"], "1 day", "2 days")
    stateful.run_once(counts, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/b{n}"), "update")
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return out.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_dedup(spark, sf):
    """Every event sent twice, and kept once."""
    folder = shared_dir(spark)
    twice = _stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    stateful.run_once(stateful.deduplicated(twice, "ts", "event_id", "60 days"), lambda df, n: df.select("event_id").write.mode("overwrite").parquet(f"{folder}/out/b{n}"))
    return spark.read.schema("event_id long").option("recursiveFileLookup", "true").parquet(f"{folder}/out").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("SELECT user_id, count(*) AS n, round(sum(coalesce(value, 0)), 2) AS total FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def stream_user_state(spark, sf):
    """A count and a sum per user, held as state."""
    folder = shared_dir(spark)
    state = _stream(spark, sf).where("user_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))
    stateful.run_once(state, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/b{n}"), "update")
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return out.groupBy("user_id").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("total", "batch"), 2).alias("total"))
