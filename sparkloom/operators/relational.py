"""Joins, windows, set comparison and aggregation that the plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import materialize


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, carry: list[str]) -> DataFrame:
    """Each left row with the carried columns of the last right row of its keys at or before it.

    One shuffle on the keys and one ordered window over both sides, so no pair of rows is ever built. Of right rows
    at the same time the one with the largest carried values counts."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_carry", F.lit(None).cast(right.select(F.struct(*carry)).schema[0].dataType))
    b = right.select(*keys, at, F.lit(0).alias("_side"), F.struct(*carry).alias("_carry"))
    order = Window.partitionBy(*keys).orderBy(at, "_side", "_carry").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    found = both.withColumn("_last", F.last("_carry", ignorenulls=True).over(order)).where("_side = 1")
    return found.select(*left.columns, *[F.col(f"_last.{c}").alias(f"asof_{c}") for c in carry])


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key and change (new, modified, deleted) between two keyed snapshots."""
    a, b = before.select(key, F.col(value).alias("_a"), F.lit(1).alias("_ina")), after.select(key, F.col(value).alias("_b"), F.lit(1).alias("_inb"))
    change = F.when(F.col("_ina").isNull(), "new").when(F.col("_inb").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, key, "full_outer").withColumn("change", change).where("change IS NOT NULL").select(key, "change")


def overlapping(df: DataFrame, keys: list[str], id_: str, start: str, end: str, cell: int) -> DataFrame:
    """Pairs (a, b) of rows with equal keys whose half-open intervals of days overlap.

    Each interval is filed under the cells of days that it touches, and a pair is met only in the first cell that
    both share, so the join is on equal keys and cells."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01"))
    rows = df.select(*keys, id_, start, end).withColumn("cell", F.explode(F.sequence(F.floor(day(F.col(start)) / cell), F.floor(day(F.col(end)) / cell))))
    a = rows.select(*keys, "cell", F.col(id_).alias("a"), F.col(start).alias("s1"), F.col(end).alias("e1"))
    b = rows.select(*keys, "cell", F.col(id_).alias("b"), F.col(start).alias("s2"), F.col(end).alias("e2"))
    first = F.floor(day(F.greatest("s1", "s2")) / cell)
    return a.join(b, [*keys, "cell"]).where((F.col("a") < F.col("b")) & (F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")) & (F.col("cell") == first)).drop("cell")


def kth_match(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """The k-th left row of a key with its k-th right row: each row is used once."""
    a = left.select(key, left_id, F.row_number().over(Window.partitionBy(key).orderBy(left_id)).alias("_k"))
    b = right.select(key, right_id, F.row_number().over(Window.partitionBy(key).orderBy(right_id)).alias("_k"))
    return a.join(b, [key, "_k"]).select(key, left_id, right_id)


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with ``rank``, the place of each row in its group, from 1; a group of any size is ranked by many tasks.

    Rows are dealt into ranges of (group, order) and numbered within each; what the ranges before hold is added."""
    dealt = materialize(df.repartitionByRange(group, *order).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy(group, "_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), before.alias("_before"))
    local = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_p", group).orderBy(*order)))
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q"))
    return local.join(offsets, same).withColumn("rank", F.col("_before") + F.col("_rn")).select(*df.columns, "rank")


def stratified(df: DataFrame, stratum: str, id_: str, total: int) -> DataFrame:
    """A proportional sample with at least one row of each stratum, taken in even strides."""
    sizes = materialize(df.groupBy(stratum).agg(F.count("*").alias("_n")))
    whole = sizes.agg(F.sum("_n")).first()[0] or 1
    share = F.greatest(F.lit(1), F.floor(F.lit(total) * F.col("_n") / F.lit(whole)).cast("int"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / share).cast("int"))
    rows = ranked(df, stratum, id_).join(sizes.withColumnRenamed(stratum, "_s"), F.col(stratum).eqNullSafe(F.col("_s")))
    return rows.where(((F.col("rank") - 1) % step == 0) & ((F.col("rank") - 1) / step < share)).select(df.columns)


def top_per_group(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
