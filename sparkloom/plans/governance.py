"""Gates, reconciliations and reports over stores: what may be served, what has changed, what is left over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import predicates, text
from sparkloom.operators import relational
from sparkloom.registry import query
from sparkloom.sources.shared import materialize
from sparkloom.sources.tables import table


@query("""WITH u AS (SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN 'deleted' WHEN doc_id % 19 = 0 THEN 'deprecated' ELSE 'current' END AS lifecycle, CASE WHEN doc_id % 23 = 0 THEN 'staging' ELSE 'current' END AS status FROM documents),
ix AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 29 <> 0 UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 31 = 0 UNION ALL SELECT vec_id + 1000000000 FROM embeddings WHERE vec_id % 37 = 0),
el AS (SELECT u.id FROM u JOIN embeddings e ON e.vec_id = u.id WHERE lifecycle = 'current' AND status = 'current')
SELECT (SELECT count(*) FROM el) AS eligible, (SELECT count(*) FROM ix) AS actual, (SELECT count(*) FROM el WHERE id NOT IN (SELECT id FROM ix)) AS missing, (SELECT count(DISTINCT id) FROM ix WHERE id NOT IN (SELECT id FROM el)) AS orphan,
(SELECT count(*) - count(DISTINCT id) FROM ix) AS duplicate, (SELECT count(DISTINCT ix.id) FROM ix JOIN u ON u.id = ix.id WHERE lifecycle = 'deleted') AS deleted_residue, (SELECT count(DISTINCT ix.id) FROM ix JOIN u ON u.id = ix.id WHERE lifecycle = 'deprecated') AS deprecated_residue,
(SELECT count(DISTINCT ix.id) FROM ix JOIN u ON u.id = ix.id WHERE status <> 'current') AS excluded_residue""")
def index_residue(spark, sf):
    """An index held against the units it should serve: missing, orphaned, doubled, and left over from what is no longer served. One full join."""
    n = F.col("doc_id")
    units = table(spark, sf, "documents").select(n.alias("id"),
        F.when(n % 17 == 0, "deleted").when(n % 19 == 0, "deprecated").otherwise("current").alias("lifecycle"), F.when(n % 23 == 0, "staging").otherwise("current").alias("status"))
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    copies = F.filter(F.array(F.when(F.col("id") % 29 != 0, F.col("id")), F.when(F.col("id") % 31 == 0, F.col("id")), F.when(F.col("id") % 37 == 0, F.col("id") + 1000000000)), lambda x: x.isNotNull())
    indexed = ids.select(F.explode(copies).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    served = units.join(ids, "id", "left_semi")
    both = units.join(served.select("id", F.lit(True).alias("served")), "id", "left").join(indexed, "id", "full_outer")
    eligible = F.coalesce(F.col("served") & (F.col("lifecycle") == "current") & (F.col("status") == "current"), F.lit(False))
    there = F.col("n").isNotNull()
    return both.agg(
        F.count_if(eligible).alias("eligible"), F.coalesce(F.sum("n"), F.lit(0)).alias("actual"), F.count_if(eligible & ~there).alias("missing"), F.count_if(there & ~eligible).alias("orphan"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"), F.count_if(there & (F.col("lifecycle") == "deleted")).alias("deleted_residue"),
        F.count_if(there & (F.col("lifecycle") == "deprecated")).alias("deprecated_residue"), F.count_if(there & (F.col("status") != "current")).alias("excluded_residue"),
    )


@query("""WITH c AS (SELECT o_custkey % 50 AS view, o_orderkey AS ref, md5(o_orderkey || o_orderstatus) AS checksum, o_orderkey % 4 = 0 AS essential FROM orders), n AS (SELECT o_orderkey AS ref, md5(o_orderkey || CASE WHEN o_orderkey % 101 = 3 THEN 'X' ELSE o_orderstatus END) AS checksum FROM orders WHERE o_orderkey % 211 <> 5),
j AS (SELECT c.view, essential, CASE WHEN n.ref IS NULL THEN 'dependency_missing' WHEN n.checksum <> c.checksum THEN 'dependency_checksum_mismatch' END AS reason FROM c LEFT JOIN n ON n.ref = c.ref)
SELECT view, list_sort(list_distinct(list(reason) FILTER (reason IS NOT NULL))) AS reasons, CASE WHEN count(reason) = 0 THEN 'fresh' WHEN count(reason) FILTER (essential) = 0 THEN 'partial' ELSE 'stale' END AS status FROM j GROUP BY view""".replace("list_sort(list_distinct(list(reason) FILTER (reason IS NOT NULL)))", "coalesce(list_sort(list_distinct(list(reason) FILTER (reason IS NOT NULL))), [])"))
def dependency_changes(spark, sf):
    """Views whose captured dependencies are gone or have changed since: fresh, partial where only minor ones have, else stale."""
    key = F.col("o_orderkey")
    name = lambda status: F.md5(F.concat(key.cast("string"), status))
    orders = table(spark, sf, "orders")
    captured = orders.select((F.col("o_custkey") % 50).alias("view"), key.alias("ref"), name(F.col("o_orderstatus")).alias("checksum"), (key % 4 == 0).alias("essential"))
    current = orders.where("o_orderkey % 211 <> 5").select(key.alias("ref"), name(F.when(key % 101 == 3, "X").otherwise(F.col("o_orderstatus"))).alias("now"))
    reason = F.when(F.col("now").isNull(), "dependency_missing").when(F.col("now") != F.col("checksum"), "dependency_checksum_mismatch")
    judged = captured.join(current, "ref", "left").withColumn("reason", reason)
    status = F.when(F.count("reason") == 0, "fresh").when(F.count(F.when(F.col("essential"), F.col("reason"))) == 0, "partial").otherwise("stale")
    return judged.groupBy("view").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), status.alias("status"))


@query("""SELECT l_orderkey * 10 + l_linenumber % 3 AS native, count(*) AS n, count(DISTINCT l_suppkey) AS artifacts, min(l_partkey) AS first, max(l_partkey) AS last FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def native_id_collisions(spark, sf):
    """Native ids that several artifacts use: how often, and the first and last event that do."""
    rows = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber") % 3).alias("native"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("artifacts"), F.min("l_partkey").alias("first"), F.max("l_partkey").alias("last")).where("artifacts > 1")


@query("""SELECT lang, source, count(*) AS n, round(avg(n_chars), 2) AS mean_chars, min(n_chars) AS least, max(n_chars) AS most, count(*) FILTER (trim(text) = '') AS blank, round(count(*) FILTER (text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)) / count(*), 6) AS repeated,
round(count(l.doc_id) / count(*), 6) AS labelled, count(*) FILTER (l.quality = 1) AS good FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) GROUP BY ALL""")
def layer_report(spark, sf):
    """Per language and source: counts, lengths, blanks, repeats, and how many are labelled."""
    docs = table(spark, sf, "documents").withColumn("h", F.md5("text"))
    repeats = docs.groupBy("h").agg(F.count("*").alias("copies"))
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.lit(1).alias("known"))
    rows = docs.join(repeats, "h").join(labels, "doc_id", "left")
    share = lambda c: F.round(c / F.count("*"), 6)
    return rows.groupBy("lang", "source").agg(
        F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.trim("text") == "").alias("blank"),
        share(F.count_if(F.col("copies") > 1)).alias("repeated"), share(F.count("known")).alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"),
    )


@query("""WITH e AS (SELECT event_type AS topic, user_id % 10 AS domain, count(*) AS n, list_sort(list(event_id))[1:50] AS refs, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS span FROM events GROUP BY ALL)
SELECT topic, domain, n, len(refs)::INTEGER AS n_refs, refs[1] AS first_ref, refs[-1] AS last_ref, round(least(0.9, 0.5 + n / 200), 6) AS confidence FROM e WHERE n >= 5""")
def threshold_assertions(spark, sf):
    """What occurs at least five times is asserted, with its first 50 references and a confidence that grows with the count."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 10).alias("domain"), "event_id")
    firsts = relational.top_per_group(rows.select(F.concat_ws("/", "topic", F.col("domain").cast("string")).alias("k"), "topic", "domain", "event_id"), "k", 50, F.col("event_id"))
    refs = firsts.groupBy("topic", "domain").agg(F.count("*").cast("int").alias("n_refs"), F.min("event_id").alias("first_ref"), F.max("event_id").alias("last_ref"))
    counts = rows.groupBy("topic", "domain").agg(F.count("*").alias("n")).where("n >= 5")
    same = (counts["topic"] == refs["topic"]) & counts["domain"].eqNullSafe(refs["domain"])
    return counts.join(refs, same).select(counts["topic"], counts["domain"], "n", "n_refs", "first_ref", "last_ref", F.round(F.least(F.lit(0.9), 0.5 + F.col("n") / 200), 6).alias("confidence"))


@query("""WITH w AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS word, p_brand || CASE WHEN p_partkey % 5 = 0 THEN 'a1b2c3d4e5f6' WHEN p_partkey % 5 = 1 THEN '.json' ELSE '' END AS mark, CASE p_partkey % 6 WHEN 0 THEN 'skill_' || p_partkey WHEN 1 THEN 'src/' WHEN 2 THEN p_partkey::VARCHAR WHEN 3 THEN p_name || '.' WHEN 4 THEN 'x' ELSE p_name || '\\' END AS project FROM part)
SELECT p_partkey, word IN ('cid', 'date', 'title', 'const', 'output', 'node_modules', 'file', 'new', 'master', 'token', 'gem') AS noise_word, regexp_matches(lower(mark), '^[a-z0-9]{12,}$|^[a-z0-9]+\\.(jpg|png|jpeg|json|txt|db)$|[a-f0-9]{10,}') AS noise_mark,
p_partkey % 6 IN (3, 5) AND length(p_name) BETWEEN 2 AND 40 AS project_name, length(p_name) BETWEEN 4 AND 40 AS faithful_short, p_brand = 'Brand#7' OR contains(p_type, 'PROMO') AS restricted,
CASE WHEN length(p_name) >= 10 THEN p_brand || chr(10) || p_name WHEN length(p_type) >= 10 THEN p_brand || chr(10) || p_type END AS embed FROM w JOIN (SELECT p_partkey AS k, p_brand, p_type FROM part) x ON x.k = p_partkey""".replace("'\\' END", "chr(92) END"))
def row_predicates(spark, sf):
    """Which names are noise, real projects, faithful though short, or restricted, and what of each row is embedded."""
    key, name = F.col("p_partkey"), F.col("p_name")
    mark = F.concat("p_brand", F.when(key % 5 == 0, "a1b2c3d4e5f6").when(key % 5 == 1, ".json").otherwise(""))
    project = F.when(key % 6 == 0, F.concat(F.lit("skill_"), key.cast("string"))).when(key % 6 == 1, F.lit("src/")).when(key % 6 == 2,
        key.cast("string")).when(key % 6 == 3, F.concat(name, F.lit("."))).when(key % 6 == 4, F.lit("x")).otherwise(F.concat(name, F.lit("\\")))
    return table(spark, sf, "part").select(
        "p_partkey", predicates.is_noise(F.split_part(name, F.lit(" "), F.lit(1))).alias("noise_word"), predicates.is_noise(mark).alias("noise_mark"),
            predicates.is_project_name(project).alias("project_name"), predicates.is_faithful_short(name).alias("faithful_short"),
        predicates.is_restricted(F.col("p_brand"), F.col("p_type"), ("Brand#7",), ("PROMO",)).alias("restricted"), predicates.vectorizable(name, F.col("p_type"), F.col("p_brand"), 10).alias("embed"),
    )


@query("""WITH m AS (SELECT c_custkey, count(o_orderkey) AS evidence, coalesce(date_diff('day', min(o_orderdate), max(o_orderdate)), 0) AS span, count(DISTINCT date_trunc('year', o_orderdate)) AS recurrence, round(coalesce(avg(least(o_totalprice / 400000, 1)), 0), 4) AS strength, count(*) FILTER (o_orderstatus = 'P') AS contradictions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey, round(greatest(0, CASE WHEN evidence >= 100 THEN 1.0 WHEN evidence >= 10 THEN 0.8 WHEN evidence >= 3 THEN 0.5 ELSE 0 END + CASE WHEN span >= 90 THEN 1.0 WHEN span >= 30 THEN 0.8 WHEN span >= 7 THEN 0.5 ELSE 0 END + CASE WHEN recurrence >= 4 THEN 1.0 WHEN recurrence >= 2 THEN 0.7 WHEN recurrence >= 1 THEN 0.3 ELSE 0 END
+ CASE WHEN strength >= 0.85 THEN 1.0 WHEN strength >= 0.7 THEN 0.7 WHEN strength >= 0.5 THEN 0.4 ELSE 0 END - least(contradictions, 2) * 0.35)::DOUBLE, 2) AS score FROM m""")
def insight_scores(spark, sf):
    """A score of steps in evidence, span, recurrence and strength, less for contradictions."""
    rows = table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    metrics = rows.groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("evidence"), F.coalesce(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")), F.lit(0)).alias("span"), F.countDistinct(F.year("o_orderdate")).alias("recurrence"),
        F.round(F.coalesce(F.avg(F.least(F.col("o_totalprice") / 400000, F.lit(1))), F.lit(0.0)), 4).alias("strength"), F.count_if(F.col("o_orderstatus") == "P").alias("contradictions"),
    )
    return metrics.select("c_custkey", predicates.insight_score(*[F.col(c) for c in ("evidence", "span", "recurrence", "strength", "contradictions")]).alias("score"))


@query("""WITH s AS (SELECT o_custkey AS subject, count(*) AS n, count(DISTINCT substr(o_orderpriority, 1, 1)) AS kinds, count(DISTINCT year(o_orderdate)) AS snapshots, date_diff('day', max(o_orderdate), TIMESTAMP '1998-12-01') AS age, count(DISTINCT o_orderstatus) > 2 AS conflicting, avg(o_totalprice) AS mean, bool_or(o_orderkey % 37 = 0) AS contra FROM orders GROUP BY o_custkey)
SELECT subject, CASE WHEN n < 3 THEN 'insufficient_evidence' WHEN kinds > 4 THEN 'ineligible_cognition_type' WHEN snapshots > 6 THEN 'cross_snapshot_support' WHEN age < 0 OR age > 700 THEN 'stale_evidence' WHEN conflicting THEN 'conflicting_evidence' WHEN mean < 150000 THEN 'uncertain_evidence' WHEN contra THEN 'contraindicated' ELSE 'eligible' END AS verdict FROM s""")
def recommendation_rule(spark, sf):
    """The first of seven reasons to abstain from a recommendation, or that it may be made."""
    facts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(
        F.count("*").alias("n"), F.countDistinct(F.substring("o_orderpriority", 1, 1)).alias("kinds"),
            F.countDistinct(F.year("o_orderdate")).alias("snapshots"), F.datediff(F.lit("1998-12-01").cast("date"), F.max("o_orderdate")).alias("age"),
        (F.countDistinct("o_orderstatus") > 2).alias("conflicting"), F.avg("o_totalprice").alias("mean"), F.bool_or(F.col("o_orderkey") % 37 == 0).alias("contra"),
    )
    verdict = (
        F.when(F.col("n") < 3, "insufficient_evidence")
        .when(F.col("kinds") > 4, "ineligible_cognition_type")
        .when(F.col("snapshots") > 6, "cross_snapshot_support")
        .when((F.col("age") < 0) | (F.col("age") > 700), "stale_evidence")
        .when(F.col("conflicting"), "conflicting_evidence")
        .when(F.col("mean") < 150000, "uncertain_evidence")
        .when(F.col("contra"), "contraindicated")
        .otherwise("eligible")
    )
    return facts.select("subject", verdict.alias("verdict"))


@query("""WITH o AS (SELECT user_id, arg_max(value, struct_pack(ts := ts, e := event_id)) AS value, max(ts) AS seen, bool_or(event_type = 'error') AS confounded, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN seen < TIMESTAMP '2024-01-28' OR value IS NULL OR confounded AND n < 50 THEN 'inconclusive' WHEN user_id % 3 = 0 THEN CASE WHEN value >= 10 THEN 'pass' ELSE 'fail' END WHEN user_id % 3 = 1 THEN CASE WHEN value <= 30 THEN 'pass' ELSE 'fail' END ELSE CASE WHEN value = 15 THEN 'pass' ELSE 'fail' END END AS status,
list_filter([CASE WHEN seen < TIMESTAMP '2024-01-28' THEN 'window_incomplete' END, CASE WHEN value IS NULL THEN 'metric_missing' END, CASE WHEN confounded AND n < 50 THEN 'confounded' END], lambda x: x IS NOT NULL) AS reasons FROM o""")
def outcome_assessment(spark, sf):
    """Whether each last observation meets its target, higher, lower or equal; inconclusive where something speaks against judging."""
    at = F.struct("ts", "event_id")
    seen = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", at).alias("value"), F.max("ts").alias("seen"),
        F.bool_or(F.col("event_type") == "error").alias("c"), F.count("*").alias("n"))
    reasons = F.array_compact(F.array(F.when(F.col("seen") < F.lit("2024-01-28").cast("timestamp_ntz"), "window_incomplete"),
        F.when(F.col("value").isNull(), "metric_missing"), F.when(F.col("c") & (F.col("n") < 50), "confounded")))
    met = F.when(F.col("user_id") % 3 == 0, F.col("value") >= 10).when(F.col("user_id") % 3 == 1, F.col("value") <= 30).otherwise(F.col("value") == 15)
    return seen.select("user_id", F.when(F.size(reasons) > 0, "inconclusive").when(met, "pass").otherwise("fail").alias("status"), reasons.alias("reasons"))


@query("""WITH s AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, doc_id, n_chars, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, n_chars FROM (SELECT *, greatest(n // 20, 1) AS step FROM s) WHERE i % step = 0 AND i // step < 20""")
def sources_even_sample(spark, sf):
    """Up to 20 documents of each source in even strides."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    rows = relational.ranked(docs, "source", "doc_id").withColumn("i", F.col("rank") - 1).join(sizes, "source")
    step = F.greatest(F.floor(F.col("n") / 20), F.lit(1))
    return rows.where((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < 20)).select("source", "doc_id", "n_chars")


@query("""WITH p AS (SELECT event_id, user_id, value, MAP {'password': 'p' || event_id, 'user_id': user_id::VARCHAR, 'Api_Key': event_type, 'token': CASE WHEN event_id % 2 = 0 THEN 'null' ELSE 't' || value END, 'note': 'free', 'row_hash': md5(event_id::VARCHAR)} AS m FROM events)
SELECT event_id, '[SEALED:field-secret:fp:' || substr(sha256(m['password']), 1, 12) || ']' AS password, m['user_id'] AS user_id, '[SEALED:field-secret:fp:' || substr(sha256(m['Api_Key']), 1, 12) || ']' AS api_key, CASE WHEN m['token'] = 'null' THEN 'null' ELSE '[SEALED:field-secret:fp:' || substr(sha256(m['token']), 1, 12) || ']' END AS token, m['note'] AS note, m['row_hash'] AS row_hash FROM p WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND (value IS NOT NULL)""".replace("'t' || value", "'t' || event_id"))
def events_sealed(spark, sf):
    """Objects with the values under sensitive keys sealed by fingerprint; ids and digests stay as they are."""
    n = F.col("event_id").cast("string")
    token = F.when(F.col("event_id") % 2 == 0, F.lit("null")).otherwise(F.concat(F.lit("t"), n))
    pairs = F.create_map(F.lit("password"), F.concat(F.lit("p"), n), F.lit("user_id"), F.col("user_id").cast("string"), F.lit("Api_Key"), F.col("event_type"),
        F.lit("token"), token, F.lit("note"), F.lit("free"), F.lit("row_hash"), F.md5(n))
    rows = table(spark, sf, "events").where("user_id IS NOT NULL AND value IS NOT NULL").select("event_id", predicates.sealed_json(pairs).alias("m"))
    return rows.select("event_id", *[F.col("m")[k].alias(k.lower()) for k in ("password", "user_id", "Api_Key", "token", "note", "row_hash")])


@query("""WITH m AS (SELECT source, count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (lang IS NULL OR source IS NULL) AS unprovenanced, count(*) FILTER (n_chars <> length(text)) AS infidel, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source)
SELECT source, n, CASE WHEN n = 0 THEN 'generation_absent' WHEN ids <> n THEN 'integrity_or_fk' WHEN chars % 2 = 1 AND source = 'src4' THEN 'dataset_digest_mismatch' WHEN unprovenanced > 0 OR infidel > 0 THEN 'unprovenanced_or_invalid_fidelity' END AS failure, NOT (ids <> n OR chars % 2 = 1 AND source = 'src4' OR unprovenanced > 0 OR infidel > 0) AS ok FROM m""")
def generation_gate(spark, sf):
    """Whether each source's generation may be activated: ids unique, digest as expected, all rows with provenance and as long as they say."""
    facts = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"),
        F.count_if(F.col("lang").isNull() | F.col("source").isNull()).alias("loose"), F.count_if(F.col("n_chars") != F.char_length("text")).alias("wrong"), F.sum("n_chars").alias("chars"))
    failure = F.when(F.col("n") == 0, "generation_absent").when(F.col("ids") != F.col("n"),
        "integrity_or_fk").when((F.col("chars") % 2 == 1) & (F.col("source") == "src4"),
        "dataset_digest_mismatch").when((F.col("loose") > 0) | (F.col("wrong") > 0), "unprovenanced_or_invalid_fidelity")
    return facts.select("source", "n", failure.alias("failure"), failure.isNull().alias("ok"))


@query("""WITH f AS (SELECT s_nationkey AS snapshot, s_suppkey, CASE WHEN s_suppkey % 41 = 0 THEN 'conflict' WHEN s_suppkey % 43 = 0 THEN 'retracted' ELSE 'current' END AS lifecycle, CASE WHEN s_suppkey % 47 = 0 THEN 'x' ELSE n_name END AS region, n_name, DATE '2024-01-01' + (s_suppkey % 90)::INTEGER AS ingested, DATE '2024-03-01' + (s_suppkey % 300)::INTEGER AS valid_to FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT snapshot, count(*) AS members, CASE WHEN bool_or(lifecycle = 'conflict') THEN 'external_conflict_unresolved' WHEN bool_or(lifecycle <> 'current') THEN 'external_lifecycle_ineligible' WHEN max(ingested) > DATE '2024-04-01' THEN 'external_watermark_from_future' WHEN date_diff('day', min(ingested), DATE '2024-04-01') > 89 THEN 'external_snapshot_stale' WHEN bool_or(region <> n_name) THEN 'external_region_mismatch' WHEN min(valid_to) < DATE '2024-04-01' THEN 'external_fact_expired' END AS failure FROM f GROUP BY snapshot""")
def snapshot_policy(spark, sf):
    """The first rule that forbids to use an external snapshot: conflicts, retracted members, watermarks, region, expiry."""
    n, day = F.col("s_suppkey"), F.lit("2024-04-01").cast("date")
    facts = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_nationkey").alias("snapshot"), F.when(n % 41 == 0, "conflict").when(n % 43 == 0, "retracted").otherwise("current").alias("lifecycle"),
            F.when(n % 47 == 0, F.lit("x")).otherwise(F.col("n_name")).alias("region"), "n_name",
        F.date_add(F.lit("2024-01-01").cast("date"), (n % 90).cast("int")).alias("ingested"), F.date_add(F.lit("2024-03-01").cast("date"), (n % 300).cast("int")).alias("valid_to"),
    )
    failure = (
        F.when(F.bool_or(F.col("lifecycle") == "conflict"), "external_conflict_unresolved")
        .when(F.bool_or(F.col("lifecycle") != "current"), "external_lifecycle_ineligible")
        .when(F.max("ingested") > day, "external_watermark_from_future")
        .when(F.datediff(day, F.min("ingested")) > 89, "external_snapshot_stale")
        .when(F.bool_or(F.col("region") != F.col("n_name")), "external_region_mismatch")
        .when(F.min("valid_to") < day, "external_fact_expired")
    )
    return facts.groupBy("snapshot").agg(F.count("*").alias("members"), failure.alias("failure"))


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT 'orphan_orders' AS check, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS found UNION ALL SELECT 'orphan_lines', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'repeated_orders', (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders)
UNION ALL SELECT 'idle_customers', (SELECT count(*) FROM c WHERE n = 0) UNION ALL SELECT 'late_lines', (SELECT count(*) FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-12-01')""".replace("AS check", "AS name"))
def doctor_checks(spark, sf):
    """Health of the stores: dangling keys, repeats, idle owners, rows from after the watermark."""
    customer, orders, lines = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    one = lambda name, rows: rows.select(F.lit(name).alias("name"), "found")
    count = lambda rows: rows.agg(F.count("*").alias("found"))
    keys = customer.select(F.col("c_custkey").alias("o_custkey"))
    checks = [
        one("orphan_orders", count(orders.join(keys, "o_custkey", "left_anti"))),
        one("orphan_lines", count(lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti"))),
        one("repeated_orders", orders.agg((F.count("*") - F.countDistinct("o_orderkey")).alias("found"))),
        one("idle_customers", count(keys.join(orders, "o_custkey", "left_anti"))),
        one("late_lines", count(lines.where("l_shipdate > TIMESTAMP_NTZ '1998-12-01 00:00:00'"))),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error') THEN 'unknown_type' WHEN ts IS NULL THEN 'no_instant' WHEN user_id IS NULL THEN 'no_subject' WHEN NOT regexp_matches(props, '^\\{"k": [0-9]+\\}$') THEN 'unknown_keys' WHEN value < 0 THEN 'bad_value' END AS reason FROM events""")
def events_envelope(spark, sf):
    """Why an event's envelope is refused: its type, instant, subject, keys or value; null where it is taken."""
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    reason = (
        F.when(~F.col("event_type").isin("view", "click", "purchase", "signup", "error"), "unknown_type")
        .when(F.col("ts").isNull(), "no_instant")
        .when(F.col("user_id").isNull(), "no_subject")
        .when((F.size(F.array_except(keys, F.array(F.lit("k")))) > 0) | ~F.array_contains(keys, "k"), "unknown_keys")
        .when(F.col("value") < 0, "bad_value")
    )
    return table(spark, sf, "events").select("event_id", reason.alias("reason"))


@query("""WITH c AS (SELECT user_id AS consumer, event_id AS cursor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), l AS (SELECT *, max(cursor) OVER (PARTITION BY consumer ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT consumer, count(*) AS offered, count(*) FILTER (before IS NULL OR cursor > before) AS taken, max(cursor) AS position FROM l GROUP BY consumer""")
def consumer_checkpoints(spark, sf):
    """Named consumers whose cursors only move forward: what was offered, what was taken, and where each stands."""
    before = F.max("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("consumer"), F.col("event_id").alias("cursor"), before.alias("before"))
    return rows.groupBy("consumer").agg(F.count("*").alias("offered"), F.count_if(F.col("before").isNull() | (F.col("cursor") > F.col("before"))).alias("taken"), F.max("cursor").alias("position"))


@query("""SELECT l_partkey AS subject, l_orderkey AS version, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n, l_linestatus AS lifecycle, round(sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber), 2) AS upto FROM lineitem""")
def subject_history(spark, sf):
    """All versions of every subject in order, of any lifecycle, with what they add up to."""
    order = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_orderkey").alias("version"), F.row_number().over(order).alias("n"),
        F.col("l_linestatus").alias("lifecycle"), F.round(F.sum("l_quantity").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("upto"))


@query(r"""WITH q AS (SELECT item_id, trim(text) AS quote FROM benchmark WHERE length(trim(text)) >= 10), w AS (SELECT item_id, quote, unnest(list_distinct(list_transform(range(1, greatest(length(quote) - 8, 2)), lambda i: substr(quote, i, 10)))) AS g FROM q),
d AS (SELECT doc_id, text, n_chars FROM documents), m AS (SELECT DISTINCT w.item_id, d.doc_id FROM w JOIN d ON contains(d.text, w.g))
SELECT m.item_id, arg_max(m.doc_id, struct_pack(exact := contains(d.text, q.quote)::INTEGER + 1, n := length(d.text), id := m.doc_id)) AS best, max(contains(d.text, q.quote)::INTEGER + 1) AS strength, count(*) AS supporters FROM m JOIN d USING (doc_id) JOIN q USING (item_id) GROUP BY m.item_id""")
def best_supporting_document(spark, sf):
    """For each quote the document that supports it best: verbatim before a shared window of ten characters, then the longest, then the last.

    Windows meet by hash and are counted by (quote, document); only documents that hold all windows of a quote can hold it
    verbatim, and only their texts are fetched."""
    grams = lambda t: text.window_hashes(t, 10)
    quotes = table(spark, sf, "benchmark").select("item_id", F.trim("text").alias("quote")).where(F.char_length("quote") >= 10).withColumn("q", F.xxhash64("quote"))
    docs = table(spark, sf, "documents").select("doc_id", "text", F.xxhash64("text").alias("t"))
    held = docs.select("doc_id", F.explode(grams(F.col("text"))).alias("g")).join(quotes.select("item_id", F.explode(grams(F.col("quote"))).alias("g")), "g")
    held = materialize(held.groupBy("item_id", "doc_id").agg(F.count("*").alias("met")))
    sizes = quotes.withColumn("size", F.size(grams(F.col("quote"))))
    whole = held.join(sizes, "item_id").where("met >= size").join(docs, "doc_id").where(F.contains("text", F.col("quote"))).select("item_id", "doc_id", "t", "q", F.lit(2).alias("whole")).distinct()
    rows = held.join(docs.select("doc_id", "t", F.char_length("text").alias("n")), "doc_id").join(quotes.select("item_id", "q"), "item_id")
    rows = rows.join(whole, ["item_id", "doc_id", "t", "q"], "left").withColumn("exact", F.coalesce("whole", F.lit(1)))
    return rows.groupBy("item_id").agg(F.max_by("doc_id", F.struct("exact", "n", "doc_id")).alias("best"), F.max("exact").alias("strength"), F.count("*").alias("supporters"))


_LIKENESS = r"""WITH g AS (SELECT doc_id, lang, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS before, text FROM documents), n AS (SELECT doc_id, before IS NOT NULL AS has, list_distinct(list_transform(range(1, greatest(length(regexp_replace(lower(substr(text, 1, 400)), '[ \t\n\x0b\f\r]+', '', 'g')) - 2, 2)), lambda i: substr(regexp_replace(lower(substr(text, 1, 400)), '[ \t\n\x0b\f\r]+', '', 'g'), i, 4))) AS a,
list_distinct(list_transform(range(1, greatest(length(regexp_replace(lower(substr(coalesce(before, ''), 1, 400)), '[ \t\n\x0b\f\r]+', '', 'g')) - 2, 2)), lambda i: substr(regexp_replace(lower(substr(coalesce(before, ''), 1, 400)), '[ \t\n\x0b\f\r]+', '', 'g'), i, 4))) AS b FROM g)
SELECT doc_id, round(CASE WHEN NOT has THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 6) AS likeness FROM n"""


def _likeness(docs: DataFrame) -> DataFrame:
    """How like each text is to that of the document before it in its source, by 4-grams of letters; by rank, so no task holds a source."""
    placed = relational.ranked(docs, "source", "doc_id")
    before = placed.select("source", (F.col("rank") + 1).alias("rank"), F.col("t").alias("before"))
    rows = placed.join(before, ["source", "rank"], "left")
    return rows.select("doc_id", F.round(F.coalesce(text.gram_jaccard(F.coalesce("t", F.lit("")), F.col("before")), F.lit(0.0)), 6).alias("likeness"))


@query(_LIKENESS)
def openings_gram_jaccard(spark, sf):
    """How like the openings of 400 characters of neighbouring documents are."""
    return _likeness(table(spark, sf, "documents").select("doc_id", "source", F.lower(F.substring("text", 1, 400)).alias("t")))


@query(r"""WITH s AS (SELECT doc_id, source, regexp_replace(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+', '', 'g') AS s FROM documents),
g AS (SELECT doc_id, source, list_distinct(list_transform(range(1, greatest(length(s) - 2, 2)), lambda i: substr(s, i, 4))) AS a FROM s),
n AS (SELECT doc_id, a, lag(a) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM g)
SELECT doc_id, round(CASE WHEN b IS NULL THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 6) AS likeness FROM n""")
def texts_gram_jaccard(spark, sf):
    """How like the whole texts of neighbouring documents are."""
    return _likeness(table(spark, sf, "documents").select("doc_id", "source", F.lower(F.coalesce("text", F.lit(""))).alias("t")))
