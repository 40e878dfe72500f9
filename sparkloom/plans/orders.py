"""Join, window and state queries over orders, line items, customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import folds, relational
from sparkloom.registry import query
from sparkloom.sources.tables import table


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_dangling(spark, sf):
    return _t(spark, sf, "orders").join(_t(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def anti_not_in(spark, sf):
    done = _t(spark, sf, "orders").where("o_orderstatus = 'F' AND o_custkey IS NOT NULL").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 3 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_visible(spark, sf):
    urgent = _t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _t(spark, sf, "lineitem").where("l_quantity < 3").select("l_orderkey", "l_linenumber").join(urgent, "l_orderkey", "left_semi")


@query("SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def enrich_two_dimensions(spark, sf):
    rows = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(_t(spark, sf, "region"),
        F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""WITH i AS (SELECT l_suppkey, l_partkey, l_orderkey * 10 + l_linenumber AS id, l_shipdate::DATE AS s, (l_shipdate + INTERVAL 30 DAY)::DATE AS e FROM lineitem)
SELECT a.l_suppkey, a.l_partkey, a.id AS a, b.id AS b FROM i a JOIN i b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey AND a.id < b.id AND a.s < b.e AND b.s < a.e""")
def interval_overlap_pairs(spark, sf):
    """Deliveries of one part by one supplier whose 30-day windows overlap."""
    rows = _t(spark, sf, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.to_date("l_shipdate").alias("s"), F.date_add(F.to_date("l_shipdate"), 30).alias("e"))
    return relational.overlapping(rows, ["l_suppkey", "l_partkey"], "id", "s", "e", 30).select("l_suppkey", "l_partkey", "a", "b")


@query("""WITH a AS (SELECT c_nationkey AS k, c_custkey AS customer, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer), b AS (SELECT s_nationkey AS k, s_suppkey AS supplier, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT a.k, customer, supplier FROM a JOIN b ON a.k = b.k AND a.n = b.n""")
def crosswalk_kth(spark, sf):
    """Customers and suppliers of a nation matched one to one, in order."""
    a = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("customer"))
    b = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("supplier"))
    return relational.kth_match(a, b, "k", "customer", "supplier")


@query("SELECT o_custkey, o_orderkey, o_orderdate, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rn = 1")
def latest_wins(spark, sf):
    newest = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"), F.count("*").alias("n"))
    return newest.select("o_custkey", "m.o_orderkey", "m.o_orderdate", "n")


@query("SELECT p_brand, p_partkey AS superseded, keeper FROM (SELECT *, first_value(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_retailprice DESC, p_partkey) AS keeper FROM part) WHERE keeper <> p_partkey")
def superseded_twins(spark, sf):
    rows = _t(spark, sf, "part")
    keys = ["p_brand", "p_type", "p_size"]
    best = rows.groupBy(*keys).agg(F.min_by("p_partkey", F.struct(-F.col("p_retailprice"), "p_partkey")).alias("keeper"))
    return rows.join(best, keys).where("keeper <> p_partkey").select("p_brand", F.col("p_partkey").alias("superseded"), "keeper")


@query("""SELECT month, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, dense_rank() OVER (ORDER BY strftime(o_orderdate, '%Y-%m') DESC) AS r FROM orders) WHERE r <= 3 GROUP BY month""")
def recent_months(spark, sf):
    """The three latest months. The ranking runs over one row per month."""
    months = _t(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return months.orderBy(F.desc("month")).limit(3)


@query("""SELECT p_type, p_partkey AS part, arg_min(other, struct_pack(d := round(d, 6), o := other)) AS best, round(min(d), 4) AS gap FROM (SELECT a.p_type, a.p_partkey, b.p_partkey AS other, abs(a.p_retailprice - b.p_retailprice) AS d FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) GROUP BY ALL""")
def best_match(spark, sf):
    """For each part the one of its type, size and brand with the nearest price.

    Prices are sorted once: the nearest part has the same price, the one before or the one after."""
    keys = ["p_type", "p_size", "p_brand"]
    parts = _t(spark, sf, "part").select(*keys, F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("x"))
    prices = parts.groupBy(*keys, "x").agg(F.min("part").alias("first"))
    order = Window.partitionBy(*keys).orderBy("x")
    near = prices.select(*keys, "x", "first", *[f(c).over(order).alias(f"{name}_{c}") for name, f in (("low", F.lag), ("high", F.lead)) for c in ("x", "first")])
    rows = parts.join(near, [*keys, "x"]).withColumn("after", F.lead("part").over(Window.partitionBy(*keys, "x").orderBy("part")))
    gap = lambda y: F.round(F.abs(F.col("x") - y), 6)
    choice = lambda other, y: F.when(other.isNotNull(), F.struct(gap(y).alias("d"), other.alias("other"), F.abs(F.col("x") - y).alias("exact")))
    same = F.when(F.col("part") != F.col("first"), F.col("first")).otherwise(F.col("after"))
    best = F.least(choice(same, F.col("x")), choice(F.col("low_first"), F.col("low_x")), choice(F.col("high_first"), F.col("high_x")))
    return rows.withColumn("b", best).where("b IS NOT NULL").select("p_type", "part", F.col("b.other").alias("best"), F.round("b.exact", 4).alias("gap"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) ORDER BY rn, l_returnflag LIMIT 60")
def round_robin(spark, sf):
    """The top rows of each group, dealt in turn. Only 60 rows of each group are ranked."""
    top = relational.top_per_group(_t(spark, sf, "lineitem"), "l_returnflag", 60, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))
    return top.orderBy("rank", "l_returnflag").limit(60).select("l_orderkey", "l_linenumber", "l_returnflag", F.col("rank").alias("rn"))


@query("""WITH w AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS a, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(b - a, 4) AS gain, CASE WHEN b - a > 1000 THEN 'better' WHEN b - a < -1000 THEN 'worse' ELSE 'neutral' END AS verdict FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_arms(spark, sf):
    even = F.col("o_orderkey") % 2 == 0
    arms = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.avg(F.when(even, F.col("o_totalprice"))).alias("a"),
        F.avg(F.when(~even, F.col("o_totalprice"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    gain = F.col("b") - F.col("a")
    return arms.select("o_custkey", F.round(gain, 4).alias("gain"), F.when(gain > 1000, "better").when(gain < -1000, "worse").otherwise("neutral").alias("verdict"))


@query("""WITH k AS (SELECT s_suppkey, CASE WHEN s_acctbal < 2000 THEN 'low' WHEN s_acctbal < 6000 THEN 'medium' ELSE 'high' END AS band, s_acctbal FROM supplier) SELECT band, s_suppkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM k) WHERE rank <= 20""")
def rank_bands(spark, sf):
    band = F.when(F.col("s_acctbal") < 2000, "low").when(F.col("s_acctbal") < 6000, "medium").otherwise("high")
    rows = _t(spark, sf, "supplier").select("s_suppkey", "s_acctbal", band.alias("band"))
    return relational.top_per_group(rows, "band", 20, F.desc("s_acctbal"), F.col("s_suppkey")).select("band", "s_suppkey", "rank")


@query("""WITH f AS (SELECT l_partkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey) SELECT l_orderkey, round(avg((first_order = l_orderkey)::INTEGER), 6) AS novelty FROM lineitem JOIN f USING (l_partkey) GROUP BY l_orderkey""")
def novelty_ratio(spark, sf):
    """The share of an order's parts that no earlier order had."""
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    first = lines.groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_order"))
    return lines.join(first, "l_partkey").groupBy("l_orderkey").agg(F.round(F.avg((F.col("first_order") == F.col("l_orderkey")).cast("int")), 6).alias("novelty"))


@query("""WITH RECURSIVE r AS (SELECT s_nationkey AS k, s_suppkey AS id, s_acctbal AS cost, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier WHERE s_acctbal > 0),
g AS (SELECT k, n, id, cost <= 15000 AS took, CASE WHEN cost <= 15000 THEN cost ELSE 0 END AS spent FROM r WHERE n = 1 UNION ALL SELECT r.k, r.n, r.id, g.spent + r.cost <= 15000, CASE WHEN g.spent + r.cost <= 15000 THEN g.spent + r.cost ELSE g.spent END FROM r JOIN g ON r.k = g.k AND r.n = g.n + 1)
SELECT k, id, round(spent, 2) AS spent FROM g WHERE took""")
def greedy_budget(spark, sf):
    """Per nation, suppliers in order of balance as long as they fit what is left of a budget."""

    def step(spent, row):
        fits = (spent or 0.0) + row["cost"] <= 15000
        spent = (spent or 0.0) + row["cost"] if fits else spent or 0.0
        return spent, (row["k"], row["id"], spent, fits)

    rows = _t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("cost"), (-F.col("s_acctbal")).alias("o"))
    taken = folds.ordered_fold(rows, ["k"], ["o", "id"], step, "k long, id long, spent double, took boolean")
    return taken.where("took").select("k", "id", F.round("spent", 2).alias("spent"))


@query("""SELECT coalesce(a.month, b.month) AS month, a.n AS orders, b.n AS lines, CASE WHEN a.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'orphan' WHEN b.n < 2 * a.n THEN 'thin' ELSE 'ok' END AS level
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1) b ON a.month = b.month""")
def coverage_reconcile(spark, sf):
    a = _t(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("orders"))
    b = _t(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("lines"))
    level = F.when(F.col("orders").isNull(), "missing").when(F.col("lines").isNull(), "orphan").when(F.col("lines") < 2 * F.col("orders"), "thin").otherwise("ok")
    return a.join(b, "month", "full_outer").withColumn("level", level)


@query("""WITH x AS (SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_totalprice), 0) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN n = 0 THEN 'no_evidence' WHEN n < 5 THEN 'too_few' WHEN top < 100000 THEN 'weak' ELSE 'eligible' END AS reason, CASE WHEN n >= 20 THEN 'core' WHEN n >= 10 THEN 'common' WHEN n >= 3 THEN 'occasional' ELSE 'minor' END AS tier, round(least(0.9, 0.5 + n / 200.0), 4) AS confidence FROM x""")
def abstention_reasons(spark, sf):
    """The first of the ordered reasons that applies, a usage tier and a confidence."""
    orders = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    rows = _t(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumns({"n": F.coalesce("n", F.lit(0)), "top": F.coalesce("top", F.lit(0))})
    n = F.col("n")
    reason = F.when(n == 0, "no_evidence").when(n < 5, "too_few").when(F.col("top") < 100000, "weak").otherwise("eligible")
    tier = F.when(n >= 20, "core").when(n >= 10, "common").when(n >= 3, "occasional").otherwise("minor")
    return rows.select("c_custkey", reason.alias("reason"), tier.alias("tier"), F.round(F.least(F.lit(0.9), 0.5 + n / 200.0), 4).alias("confidence"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-01-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def keyset_page(spark, sf):
    """The page after a cursor: a filter on the sort key, not an offset."""
    after = F.to_timestamp(F.lit("1997-01-01"))
    rows = _t(spark, sf, "orders").where((F.col("o_orderdate") > after) | ((F.col("o_orderdate") == after) & (F.col("o_orderkey") > 100)))
    return rows.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""WITH s AS (SELECT o_custkey, o_orderpriority AS signal, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, list_sort(list(signal)) AS signals, count(*) AS kinds, sum(n)::BIGINT AS total FROM s GROUP BY o_custkey HAVING count(*) >= 4""")
def signal_bundles(spark, sf):
    per = _t(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("signal")).agg(F.count("*").alias("n"))
    return per.groupBy("o_custkey").agg(F.array_sort(F.collect_list("signal")).alias("signals"), F.count("*").alias("kinds"), F.sum("n").alias("total")).where("kinds >= 4")
