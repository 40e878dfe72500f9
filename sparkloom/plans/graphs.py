"""Queries over graphs: suppliers and parts joined by line items, and reply chains of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.registry import query
from sparkloom.sources.tables import table


def _supply(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), d AS (SELECT s, count(*) AS n FROM e GROUP BY s)
SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT max(n) FROM d) AS top_degree, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT s FROM d)) AS isolated, round((SELECT count(*) FROM e) / ((SELECT count(*) FROM supplier) * (SELECT count(*) FROM part)), 6) AS density""")
def graph_stats(spark, sf):
    edges = _supply(spark, sf)
    degrees = edges.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    suppliers, parts = table(spark, sf, "supplier"), table(spark, sf, "part")
    isolated = suppliers.join(degrees, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").agg(F.count("*").alias("isolated"))
    counts = degrees.agg(F.sum("n").alias("edges"), F.max("n").alias("top_degree"))
    rows = counts.join(isolated).join(suppliers.agg(F.count("*").alias("s"))).join(parts.agg(F.count("*").alias("p")))
    return rows.select((F.col("s") + F.col("p")).alias("nodes"), "edges", "top_degree", "isolated", F.round(F.col("edges") / (F.col("s") * F.col("p")), 6).alias("density"))


@query("SELECT l_suppkey AS hub, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY 1 ORDER BY degree DESC, hub LIMIT 15")
def graph_hubs(spark, sf):
    return _supply(spark, sf).groupBy(F.col("l_suppkey").alias("hub")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "hub").limit(15)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity >= 49), r AS (SELECT b FROM e GROUP BY b HAVING count(*) <= 20)
SELECT x.a AS x, y.a AS y, count(*) AS n FROM e x JOIN e y ON x.b = y.b AND x.a < y.a WHERE x.b IN (SELECT b FROM r) GROUP BY ALL""")
def graph_common_neighbours(spark, sf):
    """Suppliers by the parts they share, over parts of at most 20 suppliers."""
    edges = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return graph.common_neighbours(edges, 20)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey + 10000000 AS p FROM lineitem WHERE l_quantity >= 49), d1 AS (SELECT DISTINCT p AS id FROM e WHERE s BETWEEN 1 AND 3), d2 AS (SELECT DISTINCT s AS id FROM e WHERE p IN (SELECT id FROM d1) AND s NOT BETWEEN 1 AND 3)
SELECT s AS id, 0 AS depth FROM (SELECT unnest([1, 2, 3]) AS s) UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2""")
def graph_two_hops(spark, sf):
    edges = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 10000000).alias("b"))
    seeds = table(spark, sf, "supplier").where("s_suppkey BETWEEN 1 AND 3").select(F.col("s_suppkey").alias("id"))
    return graph.hops(edges, seeds, 2)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem)
SELECT x.a AS x, y.a AS y, count(*) AS n FROM e x JOIN e y ON x.b = y.b AND x.a < y.a GROUP BY ALL""")
def graph_common_neighbours_whole(spark, sf):
    """Suppliers by the parts they share, over all line items and parts of any number of suppliers."""
    return graph.common_neighbours(_supply(spark, sf).select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey + 10000000 AS p FROM lineitem)
SELECT s_suppkey AS seed, s_suppkey AS id, 0 AS depth FROM supplier UNION ALL SELECT s, p, 1 FROM e UNION ALL SELECT DISTINCT x.s, y.s, 2 FROM e x JOIN e y ON x.p = y.p AND x.s <> y.s""")
def graph_two_hops_whole(spark, sf):
    """What lies within two hops of each supplier, over all line items: itself, its parts, the suppliers that share one."""
    edges = _supply(spark, sf).select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 10000000).alias("b"))
    seeds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed"), F.col("s_suppkey").alias("id"), F.lit(0).alias("depth"))
    pairs = graph.common_neighbours(edges)
    both = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("seed"), F.col("y").alias("id")), F.struct(F.col("y").alias("seed"), F.col("x").alias("id")))).alias("p"))
    return seeds.unionByName(edges.select(F.col("a").alias("seed"), F.col("b").alias("id"), F.lit(1).alias("depth"))).unionByName(both.select("p.seed", "p.id", F.lit(2).alias("depth")))


@query("""WITH RECURSIVE e AS (SELECT doc_id AS a, source || lang AS g, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k, min(doc_id) OVER (PARTITION BY md5(text)) AS m FROM documents), g AS (SELECT a, m AS b FROM e WHERE a <> m UNION ALL SELECT m, a FROM e WHERE a <> m),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents WHERE doc_id IN (SELECT a FROM g) UNION SELECT r.id, g.b FROM r JOIN g ON r.other = g.a) SELECT id, min(other) AS component FROM r GROUP BY id""")
def graph_copy_components(spark, sf):
    """Components of the graph that joins each document with the first of equal text."""
    rows = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    firsts = rows.groupBy("h").agg(F.min("doc_id").alias("b"))
    return graph.components(rows.join(firsts, "h").select(F.col("doc_id").alias("a"), "b").where("a <> b"))


@query("""SELECT s.s_suppkey AS id, s.s_nationkey AS nation, count(DISTINCT l.l_orderkey) AS orders, count(DISTINCT o.o_custkey) AS customers FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY ALL""")
def graph_supplier_views(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey")
    reach = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"),
        "left").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("o_custkey").alias("customers"))
    rows = table(spark, sf, "supplier").join(reach, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("customers", F.lit(0)).alias("customers"))
