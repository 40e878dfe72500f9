"""Reporting aggregates over the order tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.registry import query
from sparkloom.sources.tables import table


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def lineitem_summary(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP '2000-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"),
    )


@query("SELECT split_part(p_type, ' ', 1) AS grp, p_brand AS name, count(*) AS n, list_sort(list(DISTINCT p_size)) AS sizes FROM part GROUP BY ALL")
def two_level_usage(spark, sf):
    """Usage by prefix group and name, with the distinct members of each."""
    return table(spark, sf, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("grp"),
        F.col("p_brand").alias("name")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("p_size")).alias("sizes"))


@query("SELECT coalesce(n_name, 'all') AS nation, coalesce(c_mktsegment, 'all') AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def segment_rollup(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = rows.rollup("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return out.select(F.coalesce("n_name", F.lit("all")).alias("nation"), F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "n", "balance")


@query("""SELECT 'c_name' AS col, round(avg((coalesce(trim(c_name), '') = '')::INTEGER), 6) AS blank FROM customer UNION ALL SELECT 'c_mktsegment', round(avg((coalesce(trim(c_mktsegment), '') = '')::INTEGER), 6) FROM customer UNION ALL SELECT 'c_acctbal', round(avg((c_acctbal IS NULL)::INTEGER), 6) FROM customer""")
def blank_rates(spark, sf):
    rows = table(spark, sf, "customer")
    blank = lambda c: F.round(F.avg((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").cast("int")), 6)
    names = ("c_name", "c_mktsegment", "c_acctbal")
    one = rows.agg(*[blank(c).alias(c) for c in names])
    return one.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("col", "blank"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS done_percent, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1")
def status_tally(spark, sf):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), done.alias("done"),
        F.round(100.0 * done / F.count("*"), 4).alias("done_percent"), F.round(F.max("o_totalprice"), 2).alias("top"))


@query("SELECT strftime(o_orderdate, '%Y') AS year, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def status_pivot(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return rows.select("year", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query()
def bootstrap_interval(spark, sf):
    """95% interval of the mean price difference between two arms of each segment, from 2,000 seeded resamples.

    Each partition draws Poisson weights for its rows, which makes the resamples additive: only one pair of sums per
    resample and segment is shuffled. The draws are keyed by order and resample block, so partitioning changes nothing."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("segment"), "o_totalprice")
    draws = 2000

    def sums(batches):
        total: dict = {}
        for batch in batches:
            for key, segment, price in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = np.random.default_rng((1701, key & (1 << 63) - 1)).poisson(1.0, draws)
                n, s = total.setdefault((segment, key % 2), (np.zeros(draws, dtype=np.int64), np.zeros(draws)))
                n += w
                s += w * price
        for (segment, arm), (n, s) in total.items():
            yield pa.record_batch([pa.array([segment] * draws), pa.array(np.full(draws, arm)), pa.array(np.arange(draws)), pa.array(n), pa.array(s)], names=["segment", "arm", "draw", "n", "s"])

    parts = rows.mapInArrow(sums, "segment string, arm long, draw long, n long, s double")
    mean = lambda arm: F.sum(F.when(F.col("arm") == arm, F.col("s"))) / F.sum(F.when(F.col("arm") == arm, F.col("n")))
    drawn = parts.groupBy("segment", "draw").agg((mean(1) - mean(0)).alias("d"))
    at = lambda p: F.round(F.element_at(F.array_sort(F.collect_list("d")), int(draws * p)), 2)
    return drawn.groupBy("segment").agg(F.round(F.avg("d"), 2).alias("mean_difference"), at(0.025).alias("low"), at(0.975).alias("high"))
