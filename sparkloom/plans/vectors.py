"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scores
from sparkloom.operators import graph, relational, vectors
from sparkloom.registry import query
from sparkloom.sources.tables import table

TOP = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS id, a.label AS ql, b.label AS il, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, id) AS rank FROM p) WHERE rank <= 5) """


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def _top5(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.top_k(v, v.withColumnRenamed("id", "query"), 5)


@query(TOP + "SELECT query, id, rank, round(s, 4) AS score FROM t")
def emb_topk_cosine(spark, sf):
    return _top5(spark, sf).select("query", "id", "rank", F.round("score", 4).alias("score"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    labels = _vectors(spark, sf).select("vec_id", "label")
    top = _top5(spark, sf)
    return top.join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("il")), "id")


@query(TOP + """, h AS (SELECT query, any_value(ql) AS label, min(rank) FILTER (ql = il) AS hit, coalesce(sum(1 / log2(rank + 1)) FILTER (ql = il), 0) AS dcg, count(*) FILTER (ql = il) AS n FROM t GROUP BY query)
SELECT label, count(*) AS queries, round(avg((hit <= 1)::INTEGER::DOUBLE), 6) AS at1, round(avg(CASE WHEN hit IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall5, round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr5, round(avg(dcg / 2.9484591188793923), 6) AS ndcg5 FROM h GROUP BY label""")
def eval_recall_mrr_ndcg(spark, sf):
    """Retrieval metrics by scenario; a hit has the query's label."""
    hit = F.col("ql") == F.col("il")
    per = _judged(spark, sf).groupBy("query").agg(F.any_value("ql").alias("label"), F.min(F.when(hit, F.col("rank"))).alias("hit"),
        F.coalesce(F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"))
    mean = lambda c: F.round(F.avg(c), 6)
    return per.groupBy("label").agg(F.count("*").alias("queries"), mean((F.col("hit") <= 1).cast("int").cast("double")).alias("at1"),
        mean(F.when(F.col("hit").isNull(), 0.0).otherwise(1.0)).alias("recall5"), mean(F.coalesce(1 / F.col("hit"), F.lit(0))).alias("mrr5"), mean(F.col("dcg") / 2.9484591188793923).alias("ndcg5"))


@query(TOP + "SELECT query, CASE WHEN round(max(s), 4) >= 0.4 THEN 'knowledge' WHEN round(max(s), 4) >= 0.3 THEN 'fallback_raw' ELSE 'abstain' END AS route, count(*) FILTER (round(s, 4) >= 0.3) AS evidence, max(round(greatest(0, 1 - (1 - s) / 2), 4)) AS score FROM t GROUP BY query")
def hybrid_route(spark, sf):
    """Where a query goes, by the score of its best hit: answers, raw fallback, or none."""
    s = F.round("score", 4)
    rows = _top5(spark, sf).groupBy("query").agg(F.max(s).alias("best"), F.count_if(s >= 0.3).alias("evidence"), F.max(scores.unified_score(1 - F.col("score"))).alias("score"))
    return rows.select("query", F.when(F.col("best") >= 0.4, "knowledge").when(F.col("best") >= 0.3, "fallback_raw").otherwise("abstain").alias("route"), "evidence", "score")


PAIRS = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id) """


def _pairs(spark: SparkSession, sf: str, least: float) -> DataFrame:
    return vectors.similar_pairs(_vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), least)


@query(PAIRS.replace("WITH e", "WITH RECURSIVE e") + """, g AS (SELECT a, b FROM p WHERE s >= 0.4 UNION ALL SELECT b, a FROM p WHERE s >= 0.4), r AS (SELECT vec_id AS id, vec_id AS other FROM e UNION SELECT r.id, g.b FROM r JOIN g ON r.other = g.a)
SELECT id, min(other) AS component FROM r GROUP BY id""")
def emb_components(spark, sf):
    """Clusters of vectors with a cosine of 0.4 or more, named by their smallest id."""
    found = graph.components(_pairs(spark, sf, 0.4))
    return _vectors(spark, sf).select(F.col("vec_id").alias("id")).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query(PAIRS + """, l AS (SELECT a.label, x.id, avg(x.s) AS m FROM (SELECT a AS id, b AS other, s FROM p UNION ALL SELECT b, a, s FROM p) x JOIN e a ON a.vec_id = x.id JOIN e b ON b.vec_id = x.other AND a.label = b.label GROUP BY ALL)
SELECT label, arg_max(id, struct_pack(m := round(m, 9), n := -id)) AS medoid, round(max(m), 4) AS centrality FROM l GROUP BY label""")
def emb_label_medoid(spark, sf):
    """The vector of each label with the highest mean similarity to the others.

    The mean cosine to all others is the dot product with the label's mean unit vector, so no pairs are built."""
    rows = _vectors(spark, sf).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.withColumn("u", F.transform("v", lambda x: x / norm))
    sums = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label",
        "i").agg(F.sum("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("total"))
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    dot = F.aggregate(F.zip_with("u", "total", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = unit.join(sums, "label").join(n, "label").select("label", "vec_id", ((dot - 1) / (F.col("n") - 1)).alias("m"))
    return scored.groupBy("label").agg(F.max_by("vec_id", F.struct(F.round("m", 9), -F.col("vec_id"))).alias("medoid"), F.round(F.max("m"), 4).alias("centrality"))


@query(PAIRS + "SELECT x.label AS la, y.label AS lb, count(*) AS n, round(max(s), 4) AS best FROM p JOIN e x ON x.vec_id = p.a JOIN e y ON y.vec_id = p.b WHERE s >= 0.35 GROUP BY ALL")
def emb_cross_label_links(spark, sf):
    labels = _vectors(spark, sf).select("vec_id", "label")
    pairs = _pairs(spark, sf, 0.35)
    named = pairs.join(labels.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")
    return named.groupBy("la", "lb").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("best"))


@query(TOP + "SELECT query, ql AS label, il AS other, max(round(s, 4)) AS best, count(*) AS n FROM t GROUP BY ALL")
def emb_group_topk(spark, sf):
    """Hits folded to one row per query and group, as a search by session is."""
    return _judged(spark, sf).groupBy("query", F.col("ql").alias("label"), F.col("il").alias("other")).agg(F.max(F.round("score", 4)).alias("best"), F.count("*").alias("n"))


@query(TOP + ", c AS (SELECT id % 50 AS rep, query, rank, id FROM t) SELECT query, id, rank, n AS cluster_size FROM (SELECT *, row_number() OVER (PARTITION BY query, rep ORDER BY rank) AS k, count(*) OVER (PARTITION BY query, rep) AS n FROM c) WHERE k = 1")
def emb_merge_collapse(spark, sf):
    """Hits folded to the best one of each merge cluster."""
    rows = _top5(spark, sf).withColumn("rep", F.col("id") % 50)
    sizes = rows.groupBy("query", "rep").agg(F.count("*").alias("cluster_size"))
    return relational.first_by(rows, ["query", "rep"], F.col("rank")).join(sizes, ["query", "rep"]).select("query", "id", "rank", "cluster_size")
