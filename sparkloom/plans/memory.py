"""Memory items, their relations, and the gates on them. Customers, suppliers and parts stand for memories of three types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text, tokens
from sparkloom.operators import graph, relational
from sparkloom.registry import query
from sparkloom.sources.shared import materialize
from sparkloom.sources.tables import table

ITEMS = """WITH RECURSIVE it AS (SELECT 'pref' AS type, 'pref:' || p_partkey AS id, lower(p_name) AS subject, p_brand AS subtype, round(p_size / 50, 4) AS confidence, p_partkey % 97 AS ref FROM part
UNION ALL SELECT 'skill', 'skill:' || s_suppkey, 's' || s_suppkey % 30, 'n' || s_nationkey, round((s_suppkey % 100) / 100, 4), s_suppkey % 97 FROM supplier)
"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """(type, id, subject, subtype, confidence, ref) of every part and supplier."""
    parts = table(spark, sf, "part").select(F.lit("pref").alias("type"), F.concat(F.lit("pref:"), F.col("p_partkey").cast("string")).alias("id"),
        F.lower("p_name").alias("subject"), F.col("p_brand").alias("subtype"), F.round(F.col("p_size") / 50, 4).alias("confidence"), (F.col("p_partkey") % 97).alias("ref"))
    number = F.col("s_suppkey")
    suppliers = table(spark, sf, "supplier").select(F.lit("skill"), F.concat(F.lit("skill:"), number.cast("string")),
        F.concat(F.lit("s"), (number % 30).cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.round(number % 100 / 100, 4), number % 97)
    return parts.union(suppliers)


def recall_signals(items: DataFrame) -> DataFrame:
    """(signal, key, first, n): the groups in which memories recall each other, by type and subtype, word of the subject, or reference.

    Members are named once per group, and pairs with the group's first: the pairs themselves grow with its square."""
    signals = F.array(
        F.struct(F.lit("same_type_subtype").alias("signal"), F.concat_ws("/", "type", "subtype").alias("key")),
        F.struct(F.lit("shared_linked_ref").alias("signal"), F.col("ref").cast("string").alias("key")),
    )
    words = F.transform(F.array_distinct(F.regexp_extract_all("subject", F.lit("[a-z0-9_]{2,}"), F.lit(0))), lambda w: F.struct(F.lit("subject_token_overlap").alias("signal"), w.alias("key")))
    found = items.select("id", F.explode(F.concat(signals, words)).alias("s")).select("id", "s.*")
    return found.groupBy("signal", "key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")


@query(ITEMS + """, s AS (SELECT id, 'same_type_subtype' AS signal, type || '/' || subtype AS key FROM it UNION ALL SELECT id, 'shared_linked_ref', ref::VARCHAR FROM it UNION ALL SELECT DISTINCT id, 'subject_token_overlap', unnest(regexp_extract_all(subject, '[a-z0-9_]{2,}')) FROM it)
SELECT signal, key, min(id) AS first, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1""")
def memory_recall_signals(spark, sf):
    """Why memories may be related: groups of one type and subtype, of a word, or of a reference."""
    return recall_signals(_items(spark, sf))


@query("""WITH l AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n FROM lineitem),
u AS (SELECT 'uses_tool' AS relation, 'part:' || part AS src, 'supplier:' || supplier AS dst, round(least(1.0, n / 50), 2) AS strength FROM l),
t AS (SELECT 'relates_to_topic', 'part:' || p_partkey, 'topic:' || split_part(p_name, ' ', 2), 0.8 FROM part),
e AS (SELECT 'enables', 'supplier:' || s_suppkey, 'nation:' || n_name, 0.7 FROM supplier JOIN nation ON n_nationkey = s_nationkey),
b AS (SELECT 'embodies', 'nation:' || n_name, 'region:' || r_name, 0.6 FROM nation JOIN region ON r_regionkey = n_regionkey),
n AS (SELECT p_name, count(DISTINCT p_type) AS types, min(p_partkey) AS first FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1),
s AS (SELECT 'same_subject', 'part:' || first, 'part:' || p_partkey, 0.9 FROM part JOIN n USING (p_name) JOIN (SELECT p_partkey AS k, p_type AS ft FROM part) f ON f.k = first WHERE p_partkey <> first AND p_type <> ft)
SELECT relation, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, round(avg(strength), 4) AS strength FROM (SELECT * FROM u UNION ALL SELECT * FROM t UNION ALL SELECT * FROM e UNION ALL SELECT * FROM b UNION ALL SELECT * FROM s) GROUP BY relation""")
def memory_relations(spark, sf):
    """Relations of five types by rules, counted: tools used, topics, what enables and embodies what, and equal subjects of other types."""
    part, supplier, nation, region, lines = (table(spark, sf, t) for t in ("part", "supplier", "nation", "region", "lineitem"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda rows, relation, src, dst, strength: rows.select(F.lit(relation).alias("relation"), src.alias("src"), dst.alias("dst"), strength.cast("double").alias("strength"))
    uses = edge(lines.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")), "uses_tool", name("part", "l_partkey"), name("supplier", "l_suppkey"),
        F.round(F.least(F.lit(1.0), F.col("n") / 50), 2))
    topics = edge(part, "relates_to_topic", name("part", "p_partkey"), F.concat(F.lit("topic:"), F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit(0.8))
    enables = edge(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "enables", name("supplier", "s_suppkey"), name("nation", "n_name"), F.lit(0.7))
    embodies = edge(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "embodies", name("nation", "n_name"), name("region", "r_name"), F.lit(0.6))
    firsts = part.groupBy("p_name").agg(F.min(F.struct("p_partkey", "p_type")).alias("f"))
    same = edge(part.join(firsts, "p_name").where("p_type <> f.p_type"), "same_subject", F.concat(F.lit("part:"), F.col("f.p_partkey").cast("string")), name("part", "p_partkey"), F.lit(0.9))
    every = uses.union(topics).union(enables).union(embodies).union(same)
    return every.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), F.round(F.avg("strength"), 4).alias("strength"))


CANDIDATES = """WITH c AS (SELECT o_orderkey AS id, o_custkey % 60 AS src, o_orderkey % 60 AS dst, CASE WHEN o_orderkey % 7 = 0 THEN '[]' WHEN o_orderkey % 7 = 1 THEN '["r1"," ","r1","r2"]' ELSE '["r' || o_custkey % 5 || '"]' END AS refs, round((o_orderkey * 31 % 100) / 100, 2) AS similarity, CASE WHEN o_orderkey % 2 = 0 THEN 'semantic_candidate' ELSE 'rule_candidate' END AS type FROM orders),
f AS (SELECT *, CASE WHEN src = dst THEN 'self_pair' WHEN refs = '[]' THEN 'missing_source_refs' WHEN type = 'semantic_candidate' AND similarity < 0.78 THEN 'low_similarity' END AS early FROM c),
d AS (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst), type, early IS NULL ORDER BY id) AS n FROM f)
"""


def relation_candidates(rows: DataFrame) -> DataFrame:
    """Candidates(id, src, dst, refs, similarity, type) with the first reason to drop each, or null: itself, no references, unlike, or a pair seen before."""
    early = (
        F.when(F.col("src") == F.col("dst"), "self_pair")
        .when(F.size("refs") == 0, "missing_source_refs")
        .when((F.col("type") == "semantic_candidate") & (F.col("similarity") < 0.78), "low_similarity")
    )
    judged = rows.withColumn("early", early)
    pair = F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "type")
    firsts = judged.where("early IS NULL").groupBy(pair.alias("pair")).agg(F.min("id").alias("first"))
    joined = judged.withColumn("pair", pair).join(firsts, "pair", "left")
    return joined.withColumn("reason", F.coalesce("early", F.when(F.col("id") != F.col("first"), "duplicate_pair"))).drop("early", "first", "pair")


@query(CANDIDATES + """SELECT id, CASE WHEN early IS NOT NULL THEN early WHEN n > 1 THEN 'duplicate_pair' END AS reason, substr(sha1(least(src, dst) || '|' || greatest(src, dst)), 1, 16) AS pair_id, CASE WHEN refs = '[]' THEN 0 WHEN id % 7 = 1 THEN 2 ELSE 1 END AS n_refs FROM d""")
def relation_candidate_filter(spark, sf):
    """Relation candidates and why they are dropped; references are kept once each, in the order they are named."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    refs = F.when(key % 7 == 0, F.lit("[]")).when(key % 7 == 1, F.lit('["r1"," ","r1","r2"]')).otherwise(F.concat(F.lit('["r'), (cust % 5).cast("string"), F.lit('"]')))
    listed = F.array_distinct(F.filter(F.from_json(refs, "array<string>"), lambda r: F.trim(r) != ""))
    rows = table(spark, sf, "orders").select(key.alias("id"), (cust % 60).alias("src"), (key % 60).alias("dst"), listed.alias("refs"),
        F.round(key * 31 % 100 / 100, 2).alias("similarity"), F.when(key % 2 == 0, "semantic_candidate").otherwise("rule_candidate").alias("type"))
    return relation_candidates(rows).select("id", "reason", text.pair_id(F.col("src"), F.col("dst")).alias("pair_id"), F.size("refs").alias("n_refs"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey % 80 AS src, o_orderkey % 80 AS dst, ['supports', 'contradicts', 'extends', 'no_relation', 'guess'][1 + (o_orderkey // 80) % 5] AS relation, round((o_orderkey * 17 % 100) / 100, 2) AS confidence, 'r' || o_orderkey % 6 AS evidence, ['r1', 'r2', 'r3', 'r4'] AS allowed, o_orderkey % 11 = 0 AS risk FROM orders),
p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(DISTINCT relation) AS kinds FROM r WHERE relation <> 'no_relation' AND confidence >= 0.75 GROUP BY ALL)
SELECT id, CASE WHEN src = dst THEN 'rejected' WHEN relation NOT IN ('supports', 'contradicts', 'extends') THEN 'rejected' WHEN confidence < 0.5 THEN 'rejected' WHEN NOT list_contains(allowed, evidence) THEN 'rejected' WHEN coalesce(p.kinds, 0) > 1 OR risk OR confidence < 0.75 THEN 'review' ELSE 'accepted' END AS status,
CASE WHEN src = dst THEN 'self_loop' WHEN relation NOT IN ('supports', 'contradicts', 'extends') THEN 'unknown_relation_type' WHEN confidence < 0.5 THEN 'low_confidence' WHEN NOT list_contains(allowed, evidence) THEN 'unsupported_evidence' WHEN coalesce(p.kinds, 0) > 1 THEN 'pair_conflict' WHEN risk THEN 'risk_flags_present' WHEN confidence < 0.75 THEN 'mid_confidence' ELSE 'accepted' END AS reason
FROM r LEFT JOIN p ON p.a = least(src, dst) AND p.b = greatest(src, dst)""")
def relation_judgment_gate(spark, sf):
    """Judged relations accepted, rejected or sent to review, by the first rule that speaks; strong judgments of a pair that differ are a conflict."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    relation = F.element_at(F.array(*[F.lit(x) for x in ("supports", "contradicts", "extends", "no_relation", "guess")]), (F.floor(key / 80) % 5 + 1).cast("int"))
    rows = table(spark, sf, "orders").select(key.alias("id"), (cust % 80).alias("src"), (key % 80).alias("dst"), relation.alias("relation"),
        F.round(key * 17 % 100 / 100, 2).alias("confidence"), F.concat(F.lit("r"), (key % 6).cast("string")).alias("evidence"), (key % 11 == 0).alias("risk"))
    rows = rows.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    strong = rows.where("relation <> 'no_relation' AND confidence >= 0.75").groupBy("a", "b").agg(F.countDistinct("relation").alias("kinds"))
    judged = rows.join(strong, ["a", "b"], "left")
    reason = (
        F.when(F.col("src") == F.col("dst"), "self_loop")
        .when(~F.col("relation").isin("supports", "contradicts", "extends"), "unknown_relation_type")
        .when(F.col("confidence") < 0.5, "low_confidence")
        .when(~F.col("evidence").isin("r1", "r2", "r3", "r4"), "unsupported_evidence")
        .when(F.coalesce("kinds", F.lit(0)) > 1, "pair_conflict")
        .when(F.col("risk"), "risk_flags_present")
        .when(F.col("confidence") < 0.75, "mid_confidence")
        .otherwise("accepted")
    )
    status = F.when(F.col("reason") == "accepted", "accepted").when(F.col("reason").isin("pair_conflict", "risk_flags_present", "mid_confidence"), "review").otherwise("rejected")
    return judged.withColumn("reason", reason).select("id", status.alias("status"), "reason")


@query("""WITH RECURSIVE e AS (SELECT 'n' || s_nationkey AS a, 's' || s_suppkey AS b FROM supplier UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
  UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
h AS (SELECT 's1' AS id, 0 AS depth UNION SELECT e.b, h.depth + 1 FROM h JOIN e ON e.a = h.id WHERE h.depth < 6), d AS (SELECT id, min(depth) AS depth FROM h GROUP BY id)
SELECT d.id, d.depth, min(e.a) AS previous FROM d LEFT JOIN e ON e.b = d.id AND e.a IN (SELECT x.id FROM d x WHERE x.depth = d.depth - 1) GROUP BY ALL""")
def graph_shortest_paths(spark, sf):
    """From one supplier to all nodes within six steps: the length of the shortest path, and the smallest node before the last."""
    pair = lambda t, a, b, x, y: table(spark, sf, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("a"), F.concat(F.lit(b), F.col(y).cast("string")).alias("b"))
    edges = pair("supplier", "n", "s", "s_nationkey", "s_suppkey").union(pair("nation", "n", "r", "n_nationkey", "n_regionkey")).union(pair("customer", "n", "c", "c_nationkey", "c_custkey"))
    return graph.shortest_paths(edges, "s1", 6)


@query("""WITH p AS (SELECT o_custkey AS cust, o_orderkey AS id, o_totalprice AS value, o_orderpriority AS urgency FROM orders),
s AS (SELECT cust, id, round(0.5 * least(value / 500000, 1) + 0.3 * (5 - substr(urgency, 1, 1)::INTEGER) / 4 + 0.2 * (id % 10) / 10 - CASE WHEN id % 13 = 0 THEN 0.25 ELSE 0 END, 6) AS score, substr(urgency, 1, 1)::INTEGER AS u FROM p)
SELECT cust, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY score DESC, u, id) AS rank FROM s) WHERE rank <= 3""")
def candidates_ranked(spark, sf):
    """The three best candidates of each customer by a weighted score less a penalty for risk; ties by urgency, then id."""
    urgency = F.substring("o_orderpriority", 1, 1).cast("int")
    score = 0.5 * F.least(F.col("o_totalprice") / 500000, F.lit(1)) + 0.3 * (5 - urgency) / 4 + 0.2 * (F.col("o_orderkey") % 10) / 10 - F.when(F.col("o_orderkey") % 13 == 0, 0.25).otherwise(0)
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), F.round(score, 6).alias("score"), urgency.alias("u"))
    return relational.top_per_group(rows, "cust", 3, F.desc("score"), F.col("u"), F.col("id")).select("cust", "id", "score", "rank")


@query("""WITH m AS (SELECT user_id, date_trunc('month', ts)::DATE AS d, date_trunc('week', ts)::DATE AS w, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT user_id, w, sum(n) AS n FROM m GROUP BY ALL), r AS (SELECT max(w) AS top FROM k),
u AS (SELECT user_id, sum(n)::BIGINT AS total, count(*) AS active, sum(n) / count(*) AS mean, coalesce(max(n) FILTER (w >= top - 14), 0) AS peak, coalesce(max(n) FILTER (w = top), 0) AS last, coalesce(avg(n) FILTER (w < top AND w >= top - 21), 0) AS before FROM k, r GROUP BY user_id)
SELECT user_id, total, active, CASE WHEN total < 5 THEN 'none' WHEN active >= 3 AND before > 0 AND last < before * 0.3 THEN 'declining_interest' WHEN active >= 4 AND mean >= 20 AND peak >= 20 THEN 'continuous_high' WHEN active >= 4 AND total >= 20 THEN 'continuous_low' WHEN peak >= 10 THEN 'recent_surge' WHEN active >= 2 THEN 'occasional' ELSE 'single' END AS tier FROM u""")
def interest_tiers(spark, sf):
    """How strong an interest is: declining, continuous at a high or low rate, surging, occasional or single."""
    weeks = table(spark, sf, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("w")).agg(F.count("*").alias("n"))
    top = F.broadcast(weeks.agg(F.max("w").alias("top")))  # one row
    rows = weeks.crossJoin(top)
    back = F.datediff("top", "w")
    users = rows.groupBy("user_id").agg(
        F.sum("n").alias("total"), F.count("*").alias("active"), (F.sum("n") / F.count("*")).alias("mean"), F.coalesce(F.max(F.when(back <= 14, F.col("n"))), F.lit(0)).alias("peak"),
        F.coalesce(F.max(F.when(back == 0, F.col("n"))), F.lit(0)).alias("last"), F.coalesce(F.avg(F.when((back > 0) & (back <= 21), F.col("n"))), F.lit(0.0)).alias("before"),
    )
    tier = (
        F.when(F.col("total") < 5, "none")
        .when((F.col("active") >= 3) & (F.col("before") > 0) & (F.col("last") < F.col("before") * 0.3), "declining_interest")
        .when((F.col("active") >= 4) & (F.col("mean") >= 20) & (F.col("peak") >= 20), "continuous_high")
        .when((F.col("active") >= 4) & (F.col("total") >= 20), "continuous_low")
        .when(F.col("peak") >= 10, "recent_surge")
        .when(F.col("active") >= 2, "occasional")
        .otherwise("single")
    )
    return users.select("user_id", "total", "active", tier.alias("tier"))


@query(ITEMS + """SELECT type, count(*) AS n, round(avg(confidence), 4) AS confidence, count(DISTINCT subject) AS subjects, list_sort(list(id ORDER BY confidence DESC, id)[1:3]) AS examples FROM it GROUP BY type""")
def memory_profile(spark, sf):
    """Memories by type: how many, how sure, and the three surest."""
    items = _items(spark, sf)
    best = relational.top_per_group(items, "type", 3, F.desc("confidence"), F.col("id")).groupBy("type").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return items.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"), F.countDistinct("subject").alias("subjects")).join(best, "type")


@query(ITEMS + """SELECT type, id, subject, confidence FROM it WHERE type = 'pref' AND contains(subject, 'ring') ORDER BY confidence DESC, id LIMIT 50 OFFSET 10""")
def memory_page(spark, sf):
    """A page of memories of a type and subject, the surest first."""
    rows = _items(spark, sf).where(F.contains("subject", F.lit("ring")) & (F.col("type") == "pref"))
    return rows.select("type", "id", "subject", "confidence").orderBy(F.desc("confidence"), "id").offset(10).limit(50)
