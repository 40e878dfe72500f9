"""Layered retrieval over embeddings and documents, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text, tokens
from sparkloom.operators import relational, retrieval, vectors
from sparkloom.registry import query
from sparkloom.sources.shared import materialize
from sparkloom.sources.tables import table

ROLES = ("knowledge", "canonical_messages", "conversation_turns")
NAMES = list(retrieval.LAYERS)
LAYER_SQL = "CASE label % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"


def _hits_sql(bound: bool) -> str:
    asked = [(i, n, 5 + q) for i, (n, q) in enumerate((n, q) for n, q in retrieval.LAYERS.items() if not retrieval.skip_reason(n, bound, ROLES))]
    cases = " ".join(f"WHEN '{n}' THEN {i}" for i, n, _ in asked)
    quota = " ".join(f"WHEN '{n}' THEN {q}" for _, n, q in asked)
    return f"""WITH it AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, {LAYER_SQL} AS layer, vec_id % 211 AS unit FROM embeddings),
pr AS (SELECT q.id AS query, i.id, i.unit, i.layer, CASE i.layer {cases} END AS lr, list_cosine_similarity(q.v, i.v) AS s FROM it q JOIN it i ON q.id <> i.id WHERE i.layer IN ({", ".join(f"'{n}'" for _, n, _ in asked)})),
rk AS (SELECT *, row_number() OVER (PARTITION BY query, layer ORDER BY round(s, 9) DESC, id) AS rank FROM pr),
fe AS (SELECT * FROM rk WHERE rank <= CASE layer {quota} END),
un AS (SELECT *, row_number() OVER (PARTITION BY query, unit ORDER BY lr, rank) AS n FROM fe),
hits AS (SELECT * FROM (SELECT query, layer, id, unit, s AS score, row_number() OVER (PARTITION BY query ORDER BY lr, rank) AS place FROM un WHERE n = 1) WHERE place <= 5)
"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    layer = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("label") % 5 + 1).cast("int"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), layer.alias("layer"), (F.col("vec_id") % 211).alias("unit"))


def _hits(spark: SparkSession, sf: str, bound: bool) -> DataFrame:
    items = _items(spark, sf)
    return retrieval.layered(items, items.select(F.col("id").alias("query"), "v"), 5, bound, ROLES)


@query(_hits_sql(True) + "SELECT query, layer, id, unit, round(score, 4) AS score, place FROM hits")
def search_layered(spark, sf):
    """Five hits of each query from the layers that a bound snapshot allows, in their order."""
    return _hits(spark, sf, True).withColumn("score", F.round("score", 4))


@query(_hits_sql(False) + """SELECT query, id, layer, round(score, 4) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 4) DESC, (layer = 'conversation_turns')::INTEGER DESC, id) AS p FROM hits) WHERE p <= 3""")
def search_merged_rank(spark, sf):
    """The hits of all layers of an unbound search in one order: score, then conversation turns."""
    hits = _hits(spark, sf, False).withColumn("score", F.round("score", 4))
    turn = F.col("layer") == "conversation_turns"
    order = retrieval.rank_key(F.col("score"), turn, turn, F.lit(""))
    return relational.top_per_group(hits.withColumn("k", order), "query", 3, F.desc("k"), F.col("id")).select("query", "id", "layer", "score", "place")


@query(_hits_sql(True) + f"""SELECT q.id AS query, l.layer, CASE WHEN l.layer = 'legacy_pad' THEN 'not_bound_to_serving_snapshot' WHEN l.layer NOT IN ({", ".join(f"'{r}'" for r in ROLES)}) THEN 'snapshot_member_missing:' || l.layer END AS skipped,
(SELECT count(*) FROM hits h WHERE h.query = q.id AND h.layer = l.layer) AS returned, greatest(0, 5 - coalesce((SELECT count(*) FROM hits h JOIN (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(NAMES))}) x(layer, r) ON x.layer = h.layer WHERE h.query = q.id AND x.r < l.r), 0)) AS open
FROM it q CROSS JOIN (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(NAMES))}) l(layer, r)""")
def search_telemetry(spark, sf):
    """What each layer gave to each query, why it was skipped, and how many places were open."""
    queries = _items(spark, sf).select(F.col("id").alias("query"))
    return retrieval.telemetry(_hits(spark, sf, True), queries, 5, True, ROLES).drop("layer_rank")


@query(_hits_sql(True) + """, ev AS (SELECT h.*, d.text, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN d.text = '' THEN 'ineligible' WHEN d.source = 'src3' THEN 'blocked' ELSE 'ok' END AS status,
CASE WHEN h.unit % 11 = 3 THEN 'superseded' ELSE 'current' END AS lifecycle, CASE WHEN h.unit % 13 = 5 THEN 'secret' ELSE 'open' END AS privacy, q.text AS asked FROM hits h LEFT JOIN documents d ON d.doc_id = h.id LEFT JOIN documents q ON q.doc_id = h.query),
tk AS (SELECT *, list_has_any(list_filter(regexp_extract_all(lower(coalesce(asked, '')), '[a-z0-9_]{2,}'), lambda w: w NOT IN (GEN)), list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}'), lambda w: w NOT IN (GEN))) AS overlap FROM ev)
SELECT query, id, CASE WHEN lifecycle = 'superseded' OR privacy = 'secret' OR status <> 'ok' OR NOT overlap THEN 'unsupported' ELSE 'supported' END AS state,
CASE WHEN lifecycle = 'superseded' THEN 'lifecycle_not_current' WHEN privacy = 'secret' THEN 'privacy_or_provenance_veto' WHEN status IN ('ineligible', 'blocked') THEN 'evidence_ineligible' WHEN status = 'missing' THEN 'evidence_missing' WHEN overlap THEN 'eligible_evidence,query_candidate_grounded' ELSE 'query_candidate_ungrounded' END AS reason FROM tk""".replace("GEN", ", ".join(f"'{w}'" for w in tokens.GENERIC if w.isascii())))
def search_evidence(spark, sf):
    """Every hit with the state of its evidence: resolved, eligible, and grounded in the query's words."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    hits = materialize(_hits(spark, sf, True).select("query", "id", "unit"))
    # A text is taken apart once, however many hits it is in.
    needed = hits.select(F.explode(F.array("query", "id")).alias("doc_id")).distinct()
    read = materialize(docs.join(needed, "doc_id").select("doc_id", "source", (F.col("text") == "").alias("blank"),
        tokens.retrieval_tokens(F.col("text")).alias("tokens"), tokens.required_literals(F.col("text")).alias("literals")))
    asked = read.select(F.col("doc_id").alias("query"), F.col("tokens").alias("words"))
    strict = hits.join(read.where(F.size("literals") > 0).select(F.col("doc_id").alias("query"), "literals"), "query").join(docs.select(F.col("doc_id").alias("id"), "text"), "id", "left")
    absent = strict.where(retrieval.literal_absent(F.col("literals"), F.coalesce("text", F.lit("")))).select("query", "id", F.lit(True).alias("absent")).distinct()
    rows = hits.join(read.drop("literals").withColumnRenamed("doc_id", "id").withColumn("there", F.lit(True)), "id", "left")
    rows = rows.join(asked, "query", "left").join(absent, ["query", "id"], "left")
    status = F.when(F.col("there").isNull(), "missing").when(F.col("blank"), "ineligible").when(F.col("source") == "src3", "blocked").otherwise("ok")
    lifecycle = F.when(F.col("unit") % 11 == 3, "superseded").otherwise("current")
    privacy = F.when(F.col("unit") % 13 == 5, "secret").otherwise("open")
    overlap = F.coalesce(F.arrays_overlap("words", "tokens"), F.lit(False))
    verdict = retrieval.verdict(overlap, F.coalesce("absent", F.lit(False)), lifecycle, privacy, status)
    return rows.select("query", "id", verdict.alias("v")).select("query", "id", "v.*")


SCORES = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS id, a.label AS ql, b.label AS il, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, id) AS rank FROM p) WHERE rank <= 5),
c AS (SELECT query, any_value(ql) AS label, min(rank) FILTER (ql = il) AS hit, max(round(s, 4)) AS best, (query * 37) % 101 + 5 AS latency FROM t GROUP BY query)
"""


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Per query: its label, the rank of its first relevant hit, its best score, and a latency."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    top = vectors.top_k(rows.select("id", "v"), rows.select(F.col("id").alias("query"), "v"), 5)
    labels = rows.select("id", "label")
    both = top.join(labels.select(F.col("id").alias("query"), F.col("label").alias("ql")), "query").join(labels.withColumnRenamed("label", "il"), "id")
    cases = both.groupBy("query").agg(F.any_value("ql").alias("label"), F.min(F.when(F.col("ql") == F.col("il"), F.col("rank"))).alias("hit"), F.max(F.round("score", 4)).alias("best"))
    return cases.withColumn("latency", F.col("query") * 37 % 101 + 5)


@query(SCORES + """, r AS (SELECT latency, count(*) AS n FROM c GROUP BY latency), u AS (SELECT latency, sum(n) OVER (ORDER BY latency) AS upto, sum(n) OVER () AS total FROM r)
SELECT count(*) AS n, count(*) FILTER (label >= 8) AS n_abstain, count(*) FILTER (label >= 8 AND best >= 0.4) AS no_answer_fp, round(count(*) FILTER (label >= 8 AND best >= 0.4) / count(*) FILTER (label >= 8), 6) AS no_answer_fp_rate,
round(count(*) FILTER (label < 8 AND hit <= 5) / count(*) FILTER (label < 8), 6) AS recall5, round(sum(1 / hit) FILTER (label < 8) / count(*) FILTER (label < 8), 6) AS mrr5,
(SELECT min(latency) FROM u WHERE upto > total * 50 // 100) AS p50, (SELECT min(latency) FROM u WHERE upto > total * 95 // 100) AS p95, count(*) FILTER (label < 8) < 5 AS insufficient FROM c""")
def eval_abstain_latency(spark, sf):
    """Recall over queries that have an answer, false answers to those that have none, and latencies at the floor of their index.

    Percentiles come from counts per latency, so no list of all of them is built."""
    cases = materialize(_cases(spark, sf))
    none, some = F.col("label") >= 8, F.col("label") < 8
    false = F.count_if(none & (F.col("best") >= 0.4))
    sums = cases.agg(
        F.count("*").alias("n"), F.count_if(none).alias("n_abstain"), false.alias("no_answer_fp"), F.round(false / F.count_if(none), 6).alias("no_answer_fp_rate"),
        F.round(F.count_if(some & (F.col("hit") <= 5)) / F.count_if(some), 6).alias("recall5"),
            F.round(F.sum(F.when(some, 1 / F.col("hit"))) / F.count_if(some), 6).alias("mrr5"), (F.count_if(some) < 5).alias("insufficient"),
    )
    counts = cases.groupBy("latency").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("latency")))  # one row per different latency
    total = F.lit(cases.count())
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(total * p / 100), F.col("latency")))
    return sums.crossJoin(F.broadcast(upto.agg(at(50).alias("p50"), at(95).alias("p95"))))  # one row each


_DRAWS = SCORES + """, d AS (SELECT row_number() OVER (ORDER BY query) - 1 AS i, (coalesce(hit, 9) <= 5)::INTEGER - (coalesce(hit, 9) <= 1)::INTEGER AS d FROM c WHERE query % 5 = 0), n AS (SELECT count(*) AS n, avg(d) AS mean FROM d),
b AS (SELECT x.b, y.j, ('0x' || substr(md5(x.b || '|' || y.j), 1, 8))::BIGINT % (SELECT n FROM n) AS i FROM range(0, 10000) x(b), range(0, (SELECT n FROM n)) y(j)),
m AS (SELECT b.b, round(sum(d.d) / (SELECT n FROM n), 9) AS m FROM b JOIN d ON d.i = b.i GROUP BY b.b), q AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS pos FROM m)
SELECT n, round(mean, 6) AS mean, (SELECT round(m, 6) FROM q WHERE pos = 250) AS low, (SELECT round(m, 6) FROM q WHERE pos = 9750) AS high FROM n"""


def _bootstrap(cases: DataFrame) -> DataFrame:
    hit = lambda k: (F.coalesce("hit", F.lit(9)) <= k).cast("int")
    numbered = relational.ranked(cases.select(F.lit(0).alias("all"), "query", (hit(5) - hit(1)).alias("d")), "all", "query")
    return retrieval.paired_bootstrap(materialize(numbered.select((F.col("rank") - 1).cast("long").alias("i"), "d")))


@query(_DRAWS)
def eval_paired_bootstrap(spark, sf):
    """What five hits gain over one on a set of evaluation queries (every fifth), with the bounds of 10,000 paired draws."""
    return _bootstrap(_cases(spark, sf).where("query % 5 = 0"))


@query(_DRAWS.replace(" WHERE query % 5 = 0", ""))
def eval_paired_bootstrap_whole(spark, sf):
    """The same over all evaluation queries."""
    return _bootstrap(_cases(spark, sf))


@query(SCORES + """, m AS (SELECT label, count(*) AS n, round(avg((coalesce(hit, 9) <= 5)::INTEGER), 6) AS recall5, round(avg(coalesce(1 / hit, 0)), 6) AS mrr5, round(avg(CASE WHEN best >= 0.4 THEN 1 ELSE 0 END), 6) AS answered FROM c GROUP BY label),
g AS (SELECT avg(recall5) AS r, avg(mrr5) AS m FROM m)
SELECT label, list_filter([CASE WHEN n < 5 THEN 'insufficient_cases' END, CASE WHEN recall5 < round(g.r, 6) - 0.1 THEN 'recall_below_baseline' END, CASE WHEN mrr5 < round(g.m, 6) - 0.02 THEN 'mrr_drop' END, CASE WHEN answered < 0.1 THEN 'few_answers' END], lambda x: x IS NOT NULL) AS reasons,
CASE WHEN n < 5 OR recall5 < round(g.r, 6) - 0.1 OR mrr5 < round(g.m, 6) - 0.02 OR answered < 0.1 THEN 'FAIL' ELSE 'PASS' END AS gate FROM m, g""")
def eval_promotion_gate(spark, sf):
    """Whether each label's retrieval may be promoted, held against the mean over labels, and the reasons if not."""
    mean = lambda c: F.round(F.avg(c), 6)
    metrics = _cases(spark, sf).groupBy("label").agg(F.count("*").alias("n"), mean((F.coalesce("hit", F.lit(9)) <= 5).cast("int")).alias("recall5"),
        mean(F.coalesce(1 / F.col("hit"), F.lit(0.0))).alias("mrr5"), mean((F.col("best") >= 0.4).cast("int")).alias("answered"))
    metrics = materialize(metrics)
    base = F.broadcast(metrics.agg(F.round(F.avg("recall5"), 6).alias("r"), F.round(F.avg("mrr5"), 6).alias("m")))  # one row
    reasons = F.array_compact(F.array(
        F.when(F.col("n") < 5, "insufficient_cases"), F.when(F.col("recall5") < F.col("r") - 0.1, "recall_below_baseline"),
        F.when(F.col("mrr5") < F.col("m") - 0.02, "mrr_drop"), F.when(F.col("answered") < 0.1, "few_answers"),
    ))
    return metrics.crossJoin(base).select("label", reasons.alias("reasons"), F.when(F.size(reasons) > 0, "FAIL").otherwise("PASS").alias("gate"))


@query("""WITH q AS (SELECT item_id, lower(substr(text, 1, 15)) AS snip FROM benchmark WHERE length(text) >= 15), r AS (SELECT doc_id, lower(text) AS t, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, lang FROM documents)
SELECT item_id, lang, min(rank) AS rank FROM q JOIN r ON contains(r.t, q.snip) GROUP BY ALL""")
def eval_snippet_rank(spark, sf):
    """The first document, in each language's order of length, that holds the first 15 characters of an item.

    Windows of 15 characters are joined by hash with the items' openings, so no pair of texts is compared."""
    items = table(spark, sf, "benchmark").where(F.char_length("text") >= 15).select("item_id", F.xxhash64(F.lower(F.substring("text", 1, 15))).alias("h"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.lower("text").alias("t"))
    windows = F.array_distinct(F.transform(text.windows(F.col("t"), 15), lambda w: F.xxhash64(w)))
    held = docs.select("doc_id", "lang", "n_chars", F.explode(windows).alias("h")).join(items, "h")
    first = held.groupBy("item_id", "lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))
    ranks = relational.ranked(docs.select("doc_id", "lang", (-F.col("n_chars")).alias("shorter")), "lang", "shorter", "doc_id").select("doc_id", "rank")
    return first.join(ranks, "doc_id").select("item_id", "lang", "rank")
