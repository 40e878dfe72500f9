"""Sealing, canonical units, notices under budgets, maintained results, manifests, resumable builds, runs and paths."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import sealing
from sparkloom.operators import canonical, coordination, gates, incremental, manifests, noise, sequences
from sparkloom.registry import query
from sparkloom.sources.shared import materialize, shared_dir
from sparkloom.sources.tables import table
from sparkloom.sources.versioned import Versioned


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _pads(key: str) -> tuple[str, str]:
    """The two pads of the keyed fingerprint as hex, which is all that SQL needs of the key."""
    block = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    block = block.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


_INNER, _OUTER = _pads(sealing.DEFAULT_KEY)
#: The rules that any text of the given tables matches, as patterns with what comes before the value, and the value:
#: SQL needs no others to agree. Place in the order of rules, kind, pattern of lead and value, tail, test of the value.
_FIRING = [
    (32, "cookie-pair", r"(?i)\b((?:session|sessionid|sid|auth|token|jwt|access_token|refresh_token|remember_me|connect\.sid)\s*=\s*)([^\s;,]{8,})", "", "true"),
    (33, "labeled-hex-secret", r"(?i)((?:secret|token|key|password|passwd|seed|private)\s*[:=]\s*[\"'']?)([a-f0-9]{32,})", r"[\"'']?", "true"),
    (34, "labeled-b64-secret", r"(?i)((?:secret|token|key|password|passwd|credential)\s*[:=]\s*[\"'']?)([A-Za-z0-9+/]{40,}={0,2})", r"[\"'']?", "true"),
    (35, "email", r"()([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", "", "NOT regexp_matches(substr(text, CAST(e + 1 AS BIGINT), 1), '[A-Za-z0-9._%+-]')"),
    (39, "bank-card", r"()([0-9]+)", "", "regexp_matches(v, '^[3-6][0-9]{12,18}$') AND list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN (length(v) - i) % 2 = 0 THEN CAST(substr(v, i, 1) AS INTEGER) WHEN CAST(substr(v, i, 1) AS INTEGER) > 4 THEN 2 * CAST(substr(v, i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(v, i, 1) AS INTEGER) END)) % 10 = 0"),
]


def _spans_sql() -> str:
    parts = []
    for rule, kind, pattern, tail, test in _FIRING:
        marked = f"regexp_replace(text, '{pattern}{tail}', chr(1) || '\\0' || chr(2), 'g')"
        pieces = f"SELECT doc_id, text, unnest(string_split({marked}, chr(1))) AS piece, generate_subscripts(string_split({marked}, chr(1)), 1) AS n FROM d"
        placed = f"SELECT doc_id, text, n, split_part(piece, chr(2), 1) AS hit, coalesce(sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM ({pieces})"
        cut = f"SELECT doc_id, text, CAST(at_ AS BIGINT) AS s, CAST(at_ + length(hit) AS BIGINT) AS e, CAST(at_ AS BIGINT) + length(regexp_extract(hit, '^{pattern}', 1)) AS a, regexp_extract(hit, '^{pattern}', 2) AS v FROM ({placed}) WHERE n > 1"
        parts.append(f"SELECT doc_id, {rule} AS rule, '{kind}' AS kind, s, e, a, a + length(v) AS b, v FROM ({cut}) WHERE {test}")
    return " UNION ALL ".join(parts)


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_spans_sql()}),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, s - e, rule) AS i FROM f),
walk AS (
  SELECT doc_id, 0::BIGINT AS i, []::STRUCT(a BIGINT, b BIGINT, kind VARCHAR, v VARCHAR)[] AS taken FROM d
  UNION ALL
  SELECT w.doc_id, w.i + 1, CASE WHEN len(list_filter(w.taken, lambda t: o.a < t.b AND t.a < o.b)) = 0
    THEN list_append(w.taken, struct_pack(a := o.a::BIGINT, b := o.b::BIGINT, kind := o.kind, v := o.v)) ELSE w.taken END
  FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.i = w.i + 1
), last AS (
  SELECT doc_id, list_sort(arg_max(taken, i)) AS taken FROM walk GROUP BY doc_id
), m AS (
  SELECT doc_id, taken, list_transform(taken, lambda t: '[PRIVACY:' || t.kind || ':fp:' ||
    substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(t.kind || chr(0) || t.v)))), 1, 12) || ']') AS marks FROM last
)
SELECT doc_id, array_to_string(list_transform(taken, lambda t: t.kind), ',') AS kinds,
  sha256(CASE WHEN len(taken) = 0 THEN text ELSE
    array_to_string(list_transform(taken, lambda t, i: substr(text, 1 + (CASE WHEN i = 1 THEN 0 ELSE taken[i - 1].b END), t.a - (CASE WHEN i = 1 THEN 0 ELSE taken[i - 1].b END)) || marks[i]), '') || substr(text, 1 + taken[len(taken)].b) END) AS sealed_sha256
FROM m JOIN d USING (doc_id)
""")
def docs_sealed(spark, sf):
    """Every document with its credentials and personal data sealed: their kinds in order, and a digest of the sealed text."""
    rows = _docs(spark, sf).select("doc_id", sealing.sealed_text(F.coalesce("text", F.lit(""))).alias("s"))
    return rows.select("doc_id", F.array_join("s.kinds", ",").alias("kinds"), F.sha2("s.text", 256).alias("sealed_sha256"))


@query("SELECT o_custkey AS c_custkey, 2 * count(*)::BIGINT AS sealed_fields, count(*)::BIGINT AS kept_ids FROM orders GROUP BY o_custkey")
def customers_sealed_json(spark, sf):
    """Nested JSON of each customer's orders: what is under sensitive names is sealed at any depth, ids stay as they are."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    note = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.col("c_name"))
    inner = F.struct(F.struct(F.col("o_orderkey").cast("string").alias("order_id"), F.array(F.col("c_name")).alias("email"), note.alias("note")).alias("order"),
        F.array(F.struct(F.concat(F.col("c_name"), F.lit("!")).alias("access_token"))).alias("sessions"))
    sealed = rows.select("c_custkey", "o_orderkey", sealing.sealed_json(F.to_json(inner)).alias("s"))
    ids = F.get_json_object("s.text", "$.order.order_id") == F.col("o_orderkey").cast("string")
    hidden = F.get_json_object("s.text", "$.order.email[0]").startswith("[PRIVACY:field-secret:") & F.get_json_object("s.text", "$.sessions[0].access_token").startswith("[PRIVACY:field-secret:")
    return sealed.groupBy("c_custkey").agg(F.sum(F.when(hidden, F.size("s.kinds")).otherwise(0)).cast("long").alias("sealed_fields"), F.count_if(ids).cast("long").alias("kept_ids"))


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as units: their language as subject; toxic ones are in conflict, ones of low quality deprecated."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    rows = _docs(spark, sf).join(labels, "doc_id", "left")
    lifecycle = F.when(F.col("toxic") == 1, "conflict").when(F.col("quality") == 0, "deprecated").otherwise("current")
    confidence = F.round(F.least(F.lit(0.95), F.lit(0.4) + F.col("n_chars") / F.lit(10000.0)), 4)
    return rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.lit("document").alias("kind"), F.lit("user").alias("scope"),
        lifecycle.alias("lifecycle"), F.lit("").alias("question"), F.coalesce("text", F.lit("")).alias("answer"), confidence.alias("confidence"))


_LEADERS = r"""
WITH RECURSIVE l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
u AS (
  SELECT doc_id AS id, lang, coalesce(text, '') AS text, n_chars, CASE WHEN toxic = 1 THEN 'conflict' WHEN quality = 0 THEN 'deprecated' ELSE 'current' END AS lifecycle FROM documents LEFT JOIN l USING (doc_id)
), g AS (
  SELECT id, lower(trim(lang)) || '|' || (lifecycle = 'conflict') AS bucket, list_transform(list_filter(list_distinct(list_transform(range(1, greatest(length(s) - 2, 2)), lambda i: substr(s, i, 4))), lambda x: x <> ''), lambda x: hash(x)) AS m
  FROM (SELECT id, lang, lifecycle, regexp_replace(lower(' ' || text), '[ \t\n\x0b\f\r]+', '', 'g') AS s FROM u)
), near AS (
  SELECT a, b FROM (SELECT a.id AS a, b.id AS b, len(a.m) AS na, len(b.m) AS nb, len(list_intersect(a.m, b.m)) AS both_
    FROM g a JOIN g b ON a.bucket = b.bucket AND a.id < b.id AND len(a.m) > 0 AND len(b.m) > 0 AND 100 * least(len(a.m), len(b.m)) >= 85 * greatest(len(a.m), len(b.m)))
  WHERE 100 * both_ >= 85 * (na + nb - both_)
), before_ AS (SELECT b, list(a) AS earlier FROM near GROUP BY b
), o AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY id) AS i FROM g
), walk AS (
  SELECT bucket, 0::BIGINT AS i, []::BIGINT[] AS leaders FROM (SELECT DISTINCT bucket FROM g)
  UNION ALL
  SELECT w.bucket, w.i + 1, CASE WHEN len(list_intersect(w.leaders, coalesce(e.earlier, []))) = 0 THEN list_append(w.leaders, o.id) ELSE w.leaders END
  FROM walk w JOIN o ON o.bucket = w.bucket AND o.i = w.i + 1 LEFT JOIN before_ e ON e.b = o.id
), led AS (SELECT unnest(arg_max(leaders, i)) AS id FROM walk GROUP BY bucket
), mem AS (
  SELECT g.id, coalesce(min(n.a), g.id) AS leader FROM g LEFT JOIN (SELECT * FROM near WHERE a IN (FROM led) AND b NOT IN (FROM led)) n ON n.b = g.id GROUP BY g.id
)
"""


@query(_LEADERS + "SELECT id AS doc_id, leader FROM mem")
def units_leaders(spark, sf):
    """The leader of every unit: in the order of ids, one that no earlier leader of its bucket is like."""
    return canonical.members(_units(spark, sf)).select(F.col("id").alias("doc_id"), "leader")


@query(
    _LEADERS
    + """, c AS (SELECT mem.leader, count(*) AS n_members, min(round(least(0.95, 0.4 + n_chars / 10000.0::DOUBLE), 4)) AS confidence,
  max(list_position(['current', 'deprecated', 'superseded', 'conflict'], lifecycle)) AS worst, arg_max(struct_pack(id := u.id, lang := lang, text := text), struct_pack(n := length(text), id := -u.id)) AS best
  FROM mem JOIN u ON u.id = mem.id GROUP BY mem.leader)
SELECT leader, 'cu|' || substr(sha256(lower(trim(best.lang)) || '|document|' || substr(sha256(best.text), 1, 16)), 1, 32) AS canonical_unit, best.id AS best, confidence, ['current', 'deprecated', 'superseded', 'conflict'][worst] AS lifecycle, n_members,
  CASE WHEN n_members > 1 THEN 'similar_merge' ELSE 'single' END AS merge_reason FROM c"""
)
def units_canonical(spark, sf):
    """One canonical unit for each group of like units."""
    units = _units(spark, sf)
    return canonical.canonical_units(units, canonical.members(units))


@query(
    _LEADERS
    + """, t AS (SELECT id, lang, md5(text) AS h, lifecycle, lead(id) OVER (PARTITION BY lang, md5(text) ORDER BY id) AS copy, lead(id) OVER (PARTITION BY lang ORDER BY id) AS following,
  lead(lifecycle) OVER (PARTITION BY lang ORDER BY id) AS following_lifecycle, lead(md5(text)) OVER (PARTITION BY lang ORDER BY id) AS following_h FROM u),
p AS (SELECT true AS wanted, id AS a, copy AS b FROM t WHERE copy IS NOT NULL UNION ALL SELECT false, id, following FROM t WHERE following IS NOT NULL AND lifecycle <> following_lifecycle AND h <> following_h),
j AS (SELECT wanted, x.leader = y.leader AS merged FROM p JOIN mem x ON x.id = a JOIN mem y ON y.id = b),
s AS (SELECT count(*) FILTER (wanted) AS positives, count(*) FILTER (wanted AND merged) AS merged_positives, count(*) FILTER (NOT wanted) AS negatives, count(*) FILTER (NOT wanted AND merged) AS false_merges FROM j)
SELECT *, 0::BIGINT AS unresolved, round(merged_positives / nullif(positives, 0), 6) AS recall, CASE WHEN positives = 0 THEN 'not_applicable' WHEN merged_positives >= 0.8 * positives AND false_merges = 0 THEN 'passed' ELSE 'failed' END AS verdict FROM s"""
)
def units_merge_gate(spark, sf):
    """The grouping against pairs that must be merged (copies) and that must not (neighbours of another lifecycle and text)."""
    units = materialize(_units(spark, sf))
    by = lambda *c: Window.partitionBy(*c).orderBy("id")
    h = F.md5("answer")
    rows = units.select("id", h.alias("h"), F.lead("id").over(by("subject", h)).alias("copy"), F.lead(F.struct("id", "lifecycle", h.alias("h"))).over(by("subject")).alias("next"), "lifecycle")
    positives = rows.where("copy IS NOT NULL").select(F.col("id").alias("a"), F.col("copy").alias("b"))
    negatives = rows.where("next.id IS NOT NULL AND lifecycle <> next.lifecycle AND h <> next.h").select(F.col("id").alias("a"), F.col("next.id").alias("b"))
    return canonical.merge_gate(materialize(canonical.members(units)), units.select(F.col("id").alias("ref"), "id"), positives, negatives)


_AS_OF = "1998-08-02T12:00:00Z"
_POLICY = noise.Policy(threshold=0.45, global_budget=40, domain_budget=12, critical=0.8)


@query(f"""
WITH RECURSIVE l AS (
  SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') / count(*) AS returned, count(*) FILTER (l_discount > 0.05) / count(*) AS late, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey
), shown AS (SELECT o_custkey::VARCHAR AS key, max(l_shipdate) AS at_ FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N' GROUP BY 1
), c AS (
  SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, CASE WHEN o_orderpriority < '3' THEN 'inbox_item' ELSE 'digest_item' END AS kind, ['priority-' || substr(o_orderpriority, 1, 1), 'status-' || o_orderstatus] AS domains,
    o_custkey::VARCHAR AS key, o_custkey || '|' || o_orderpriority AS dedup, o_orderdate + INTERVAL 120 DAY AS expires, (6 - substr(o_orderpriority, 1, 1)::INTEGER) / 5.0::DOUBLE AS urgency,
    least(1.0, o_totalprice / 500000.0::DOUBLE) AS severity, returned AS goal_impact, least(1.0, suppliers / 7.0::DOUBLE) AS cross_, CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS novelty,
    least(1.0, n / 7.0::DOUBLE) AS evidence, CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.3 END AS relevance, late AS outcome, c_acctbal < -500 AS sensitive, n >= 2 AS evidence_eligible, c_mktsegment <> 'MACHINERY' AS trust
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN l ON l_orderkey = o_orderkey
), s AS (
  SELECT *, round(((((((0.0::DOUBLE + round(severity, 6) * 0.18::DOUBLE) + round(urgency, 6) * 0.18::DOUBLE) + round(goal_impact, 6) * 0.14::DOUBLE) + round(cross_, 6) * 0.10::DOUBLE) + round(novelty, 6) * 0.15::DOUBLE)
    + round(evidence, 6) * 0.15::DOUBLE) + round(relevance, 6) * 0.08::DOUBLE + round(outcome, 6) * 0.02::DOUBLE, 6) AS score FROM c
), f AS (
  SELECT s.*, CASE WHEN sensitive THEN 'abstained:privacy_veto' WHEN NOT evidence_eligible THEN 'abstained:evidence_veto' WHEN NOT trust THEN 'abstained:trust_veto' WHEN expires <= TIMESTAMP '1998-08-02 12:00:00' THEN 'expired:expired'
    WHEN score < 0.45 THEN 'abstained:below_threshold' WHEN novelty = 0 THEN 'suppressed:duplicate_no_material_change' WHEN TIMESTAMP '1998-08-02 12:00:00' - at_ < INTERVAL 24 HOUR THEN 'suppressed:cooldown_active' END AS first, score >= 0.8 AS critical
  FROM s LEFT JOIN shown USING (key)
), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, urgency DESC, id) AS i FROM f WHERE first IS NULL
), walk AS (
  SELECT 0::BIGINT AS i, NULL::VARCHAR AS id, 0::BIGINT AS used, []::VARCHAR[] AS spent, NULL::VARCHAR AS outcome
  UNION ALL
  SELECT i, id, CASE WHEN outcome = 'eligible:' THEN used + 1 ELSE used END, CASE WHEN outcome = 'eligible:' THEN list_concat(spent, domains) ELSE spent END, outcome FROM (
    SELECT o.i, o.id, w.used, w.spent, o.domains, CASE WHEN o.critical THEN 'eligible:' WHEN w.used >= 40 THEN 'suppressed:global_budget_exhausted'
      WHEN len(list_filter(o.domains, lambda d: len(list_filter(w.spent, lambda x: x = d)) >= 12)) > 0 THEN 'suppressed:domain_budget_exhausted,' || array_to_string(list_filter(o.domains, lambda d: len(list_filter(w.spent, lambda x: x = d)) >= 12), ',')
      ELSE 'eligible:' END AS outcome
    FROM walk w JOIN o ON o.i = w.i + 1)
)
SELECT f.id, split_part(coalesce(first, walk.outcome), ':', 1) AS result, split_part(coalesce(first, walk.outcome), ':', 2) AS reasons FROM f LEFT JOIN walk ON walk.id = f.id
""")
def notices_evaluated(spark, sf):
    """Orders as candidates for notices: who is vetoed, late, weak, repeated or cooling down, and whom the budgets let through."""
    lines, orders, customer = (table(spark, sf, n) for n in ("lineitem", "orders", "customer"))
    share = lambda c: F.count_if(c) / F.count("*")
    per = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), share(F.col("l_returnflag") == "R").alias("goal_impact"),
        share(F.col("l_discount") > 0.05).alias("outcome_signal"), F.countDistinct("l_suppkey").alias("suppliers"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    level = F.substring("o_orderpriority", 1, 1)
    first = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")) == 1
    most = lambda c: F.least(F.lit(1.0), c)
    candidates = rows.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"),
        F.when(F.col("o_orderpriority") < "3", "inbox_item").otherwise("digest_item").alias("kind"),
        F.array(F.concat(F.lit("priority-"), level), F.concat(F.lit("status-"), "o_orderstatus")).alias("domains"),
        F.col("o_custkey").cast("string").alias("cooldown_key"),
        F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("dedup_key"),
        (F.col("o_orderdate") + F.expr("INTERVAL 120 DAYS")).alias("expires_at"),
        ((6 - level.cast("int")) / F.lit(5.0)).alias("urgency"),
        most(F.col("o_totalprice") / F.lit(500000.0)).alias("severity"),
        "goal_impact",
        most(F.col("suppliers") / F.lit(7.0)).alias("cross_domain_impact"),
        F.when(first, 1.0).otherwise(0.0).alias("novelty"),
        most(F.col("n") / F.lit(7.0)).alias("evidence_strength"),
        F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.3).alias("user_relevance"),
        "outcome_signal",
        (F.col("c_acctbal") < -500).alias("sensitive"),
        (F.col("n") >= 2).alias("evidence_eligible"),
        (F.col("c_mktsegment") != "MACHINERY").alias("trust_eligible"),
    )
    shown = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("string").alias("key"),
        F.when(F.col("l_returnflag") == "N", "dismissed").otherwise("presented").alias("event_type"), F.col("l_shipdate").cast("timestamp").alias("at"))
    judged = noise.evaluate(materialize(candidates.withColumn("score", noise.importance())), shown, noise.Context(_AS_OF), _POLICY)
    return judged.select("id", "result", F.array_join("reasons", ",").alias("reasons"))


def _two_states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents of two days: German ones come, go and change between them, all others stay."""
    german, text = F.col("lang") == "de", F.coalesce("text", F.lit(""))
    rows = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("ref"), "doc_id", "lang", F.concat_ws("/", "lang", "source").alias("subject"), text.alias("text"))
    before = rows.where(~(german & (F.col("doc_id") % 10 == 3)))
    after = rows.where(~(german & (F.col("doc_id") % 10 == 5))).withColumn("text", F.when(german & (F.col("doc_id") % 7 == 0), F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    return before.drop("doc_id", "lang"), after.drop("doc_id", "lang")


def _per_subject(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).cast("long").alias("chars"), F.min("text").alias("first"), F.countDistinct("text").alias("texts"))


_STATES = """
WITH d AS (SELECT doc_id, lang, lang || '/' || source AS subject, coalesce(text, '') AS text FROM documents),
a AS (SELECT * FROM d WHERE NOT (lang = 'de' AND doc_id % 10 = 3)),
b AS (SELECT doc_id, subject, CASE WHEN lang = 'de' AND doc_id % 7 = 0 THEN text || ' more' ELSE text END AS text FROM d WHERE NOT (lang = 'de' AND doc_id % 10 = 5))
"""


def _maintained(spark: SparkSession, sf: str) -> tuple[incremental.Maintained, dict]:
    kept = incremental.Maintained(Versioned(spark, shared_dir(spark)), _per_subject)
    before, after = _two_states(spark, sf)
    kept.refresh(before, ["text"], expected="")
    return kept, kept.refresh(after, ["text"], expected=kept.watermark())


@query(_STATES + "SELECT subject, count(*) AS n, sum(length(text))::BIGINT AS chars, sha256(min(text)) AS first, count(DISTINCT text) AS texts FROM b GROUP BY subject")
def delta_results(spark, sf):
    """Results by subject after an incremental refresh, which must equal a build from nothing."""
    kept, _ = _maintained(spark, sf)
    return kept.results().withColumn("first", F.sha2("first", 256))


@query(_STATES + """SELECT coalesce(a.subject, b.subject) AS subject, count(*) FILTER (a.doc_id IS NULL) AS new, count(*) FILTER (b.doc_id IS NULL) AS deleted, count(*) FILTER (a.text <> b.text) AS modified
FROM a FULL JOIN b USING (doc_id) WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text <> b.text GROUP BY 1""")
def delta_changes(spark, sf):
    """What changed between two states, by affected subject."""
    before, after = (rows.select("ref", "subject", F.sha2("text", 256).alias("hash")) for rows in _two_states(spark, sf))
    changed = incremental.changes(before, after).withColumn("subject", F.coalesce("subject", "subject_before"))
    count = lambda kind: F.count_if(F.col("change") == kind).cast("long").alias(kind)
    return changed.groupBy("subject").agg(count("new"), count("deleted"), count("modified"))


@query("""
WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
u AS (SELECT doc_id, toxic = 1 AS toxic, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents LEFT JOIN l USING (doc_id))
SELECT doc_id::VARCHAR AS unit_id, CASE WHEN first < doc_id THEN 'superseded' ELSE 'current' END AS lifecycle, CASE WHEN first < doc_id THEN 2 WHEN toxic THEN 3 ELSE 1 END::BIGINT AS version,
  CASE WHEN first < doc_id THEN first::VARCHAR END AS supersedes, CASE WHEN first < doc_id THEN 1 WHEN toxic THEN 2 ELSE 0 END::BIGINT AS n_events FROM u
""")
def manifests_applied(spark, sf):
    """Units after one manifest that supersedes copies, and another on toxic ones that was applied and taken back."""
    docs, labels = _docs(spark, sf), table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = F.min("doc_id").over(Window.partitionBy(F.md5(F.coalesce("text", F.lit("")))))
    rows = materialize(docs.select("doc_id", first.alias("first")).join(labels, "doc_id", "left"))
    id_, none = F.col("doc_id").cast("string"), F.lit(None).cast("string")
    ledger = manifests.Ledger(Versioned(spark, shared_dir(spark)))
    ledger.start(rows.select(id_.alias("unit_id"), F.lit("current").alias("lifecycle"), F.lit(1).cast("long").alias("version"), none.alias("supersedes"), none.alias("question"), none.alias("answer")))

    def manifest(name: str, chosen: DataFrame, action: str, target=none) -> DataFrame:
        head = [F.lit(name).alias("manifest_id"), F.col("doc_id").cast("int").alias("ordinal"), id_.alias("unit_id"), F.lit(action).alias("action"),
            F.lit(1).cast("long").alias("expected_version"), F.lit("current").alias("expected_lifecycle")]
        tail = [F.lit("reviewed").alias("reason"), F.array(id_).alias("evidence"), none.alias("question"), none.alias("answer"), F.lit("approve").alias("decision")]
        return materialize(chosen.select(*head, target.alias("target"), *tail))

    copies = manifest("copies", rows.where("first < doc_id"), "supersede", F.col("first").cast("string"))
    toxic = manifest("toxic", rows.where("first = doc_id AND toxic = 1"), "conflict")
    for actions in (copies, toxic):
        if not actions.isEmpty():
            ledger.register(actions, "reviewer one", most=None)
            ledger.apply(actions, rows.select(id_.alias("ref")))
    if ledger.status("toxic"):
        ledger.rollback("toxic")
    counted = ledger.events().groupBy("unit_id").agg(F.count("*").alias("n_events"))
    return ledger.units().join(counted, "unit_id", "left").select("unit_id", "lifecycle", "version", "supersedes", F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"))


@query("""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS word FROM documents),
c AS (SELECT doc_id, strpos('0123456789abcdef', substr(md5(word), 1, 1)) - 1 AS dim, count(*) AS n FROM w GROUP BY ALL)
SELECT d.doc_id, array_to_string(list_transform(range(0, 16), lambda i: coalesce(m[i], 0)::VARCHAR), ',') AS vector
FROM documents d LEFT JOIN (SELECT doc_id, map_from_entries(list((dim::BIGINT, n))) AS m FROM c GROUP BY doc_id) m USING (doc_id)
""")
def vectors_resumed(spark, sf):
    """Word-count vectors of all documents, built in batches by a run that dies twice and is taken up again."""
    rows = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    dims = lambda c: F.conv(F.substring(F.md5(c), 1, 1), 16, 10).cast("int")

    def embed(batch: DataFrame) -> DataFrame:
        words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
        # As a lambda's variable the words of a text are found and hashed once, not for each of the 16 numbers.
        counted = F.transform(F.array(F.transform(words, dims)), lambda all_: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.size(F.filter(all_, lambda d: d == i))))
        return batch.select("id", F.element_at(counted, 1).alias("vector"))

    class Died(RuntimeError):
        pass

    store = Versioned(spark, shared_dir(spark))
    for dies_after in (1, 3, None):

        def after(batch: int, last=dies_after) -> None:
            if batch == last:
                raise Died

        try:
            done = incremental.build_resumable(store, "vectors", rows, embed, batches=6, after_batch=after)
        except Died:
            continue
    return done.select(F.col("id").alias("doc_id"), F.array_join(F.transform("vector", lambda n: n.cast("string")), ",").alias("vector"))


def _defect_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, line, defect): every line of every document as a turn of a session."""
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "said"))
    bare = F.regexp_replace("said", r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "")
    defect = (
        F.when(bare == "", "empty")
        .when(bare.isin("**", "***", "*", "#", "##", "###"), "double_star")
        .when((bare.startswith("*") | bare.startswith("#")) & (F.char_length(bare) < 8), "double_star")
        .when((F.char_length(bare) <= 3) & ~bare.rlike(r"[\p{L}\p{N}]"), "suspicious_short")
    )
    return lines.select("doc_id", "line", defect.alias("defect"))


_LINES = r"""
WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS said, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
b AS (SELECT doc_id, line, regexp_replace(said, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS s FROM t),
d AS (SELECT doc_id, line, CASE WHEN s = '' THEN 'empty' WHEN s IN ('**', '***', '*', '#', '##', '###') THEN 'double_star' WHEN (starts_with(s, '*') OR starts_with(s, '#')) AND length(s) < 8 THEN 'double_star'
  WHEN length(s) <= 3 AND NOT regexp_matches(s, '[\p{L}\p{N}]') THEN 'suspicious_short' END AS defect FROM b),
r AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM d WHERE defect IN ('double_star', 'empty')),
runs AS (SELECT doc_id, min(line) AS start, count(*) AS length FROM r GROUP BY doc_id, island)
"""


@query(_LINES + """, k AS (SELECT doc_id, sum(length - 1) AS breaks, max(length) AS longest FROM runs GROUP BY doc_id)
SELECT d.doc_id, count(*) AS lines, count(defect) AS defects, round((count(*) - count(defect)) / count(*), 6) AS normal_rate, coalesce(any_value(breaks), 0)::BIGINT AS breaks, coalesce(any_value(longest), 0)::BIGINT AS longest_run
FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""")
def lines_quality(spark, sf):
    """Of each document's lines: how many are defective, how many follow a defect in a row, and the longest such run."""
    lines = materialize(_defect_lines(spark, sf))
    broken = lines.where("defect IN ('double_star', 'empty')").select("doc_id", "line")
    breaks = sequences.consecutive(broken, "doc_id", "line").groupBy("doc_id").agg(F.count("*").alias("breaks"))
    longest = sequences.runs(broken, "doc_id", "line").groupBy("doc_id").agg(F.max("length").alias("longest_run"))
    per = lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("defect").alias("defects"))
    out = per.join(breaks, "doc_id", "left").join(longest, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "lines", "defects", F.round((F.col("lines") - F.col("defects")) / F.col("lines"), 6).alias("normal_rate"), zero("breaks"), zero("longest_run"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS path FROM pages),
s AS (SELECT page_id, list_reverse(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda x: x NOT IN ('', '.'))) AS parts FROM p),
e AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS n, parts FROM s),
f AS (SELECT page_id, n, array_to_string(parts[1:n], '/') AS suffix FROM e),
b AS (SELECT n, suffix, min(page_id) AS match, count(DISTINCT page_id) AS ties FROM f WHERE page_id % 2 = 1 GROUP BY ALL)
SELECT f.page_id, arg_max(b.match, f.n) AS match, max(f.n) AS n, arg_max(b.ties, f.n) AS ties FROM f JOIN b ON f.n = b.n AND f.suffix = b.suffix WHERE f.page_id % 2 = 0 GROUP BY f.page_id
""")
def pages_longest_suffix(spark, sf):
    """Of two captures of one site (pages of even and of odd numbers), the page whose path ends most alike."""
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path"))
    left, right = (rows.where(F.col("page_id") % 2 == k).withColumnRenamed("page_id", c) for k, c in ((0, "left"), (1, "right")))
    found = sequences.longest_suffix(left, right)
    return found.select(F.col("left").alias("page_id"), F.col("right").alias("match"), F.col("n").cast("long").alias("n"), "ties")


@query("""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
r AS (SELECT source, CASE WHEN toxic = 1 THEN 'wrong' WHEN quality = 0 THEN 'missing' WHEN quality = 1 THEN 'helpful' END AS label, CASE WHEN lang = 'en' THEN 'knowledge' ELSE 'fallback_raw' END AS route, n_chars / 10.0::DOUBLE AS latency
  FROM documents JOIN l USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY latency) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM r),
g AS (SELECT source, count(*) AS total, count(*) FILTER (label = 'helpful') AS helpful, count(*) FILTER (label = 'wrong') AS wrong, count(*) FILTER (label = 'stale') AS stale, count(*) FILTER (label = 'missing') AS missing,
  count(*) FILTER (label IS NULL) AS unlabelled, count(*) FILTER (route = 'fallback_raw') AS fallback, max(latency) FILTER (i = n * 95 // 100) AS p95 FROM o GROUP BY source)
SELECT *, round(helpful / total, 4) AS helpful_rate, round(fallback / total, 4) AS fallback_rate,
  CASE WHEN unlabelled > 0 THEN 'awaiting_labels' WHEN helpful >= 0.8 * total AND wrong + stale = 0 AND fallback <= 0.3 * total AND p95 <= 500 THEN 'PASS' ELSE 'FAIL' END AS status FROM g
""")
def canary_gates(spark, sf):
    """Whether the labelled documents of each source would pass as a canary."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    label = F.when(F.col("toxic") == 1, "wrong").when(F.col("quality") == 0, "missing").when(F.col("quality") == 1, "helpful")
    rows = _docs(spark, sf).join(labels, "doc_id").select("source", label.alias("label"),
        F.when(F.col("lang") == "en", "knowledge").otherwise("fallback_raw").alias("route"), (F.col("n_chars") / F.lit(10.0)).alias("latency"))
    return gates.canary_gates(rows, "source")


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_spans_sql()}), leak AS (SELECT DISTINCT doc_id FROM f),
u AS (SELECT lang, doc_id, sha256('document|' || lower(trim(coalesce(source, ''))) || '|' || substr(lower(trim(coalesce(text, ''))), 1, 120)) AS key, coalesce(source, '') <> '' AND coalesce(text, '') <> '' AS complete, doc_id IN (FROM leak) AS leaks FROM documents),
g AS (SELECT lang, count(*) AS units, count(*) AS with_evidence, count(*) FILTER (complete) AS complete, count(*) - count(DISTINCT key) AS repeats, count(*) FILTER (leaks) AS leaks FROM u GROUP BY lang)
SELECT *, round(with_evidence / units, 4) AS with_evidence_rate, round(complete / units, 4) AS complete_rate, round(repeats / units, 4) AS repeats_rate, round(leaks / units, 4) AS leaks_rate FROM g
""")
def units_extraction_quality(spark, sf):
    """Coverage, completeness, repeats and leaks of documents as units, by language."""
    none = F.lit("")
    units = _docs(spark, sf).select("lang", F.lit("document").alias("unit_type"), F.col("source").alias("subject"), none.alias("question"),
        F.col("text").alias("answer"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("evidence"))
    return gates.extraction_quality(units, "lang")


_TRENDS = """
WITH s AS (SELECT user_id, event_type, value, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step, ts, event_id FROM events),
t AS (SELECT user_id, event_type, count(*) AS samples, arg_max(value, struct_pack(t := ts, e := event_id)) - arg_min(value, struct_pack(t := ts, e := event_id)) AS change, count(*) FILTER (step > 0) AS ups, count(*) FILTER (step < 0) AS downs FROM s GROUP BY ALL),
d AS (SELECT *, CASE event_type WHEN 'error' THEN 'constraint' WHEN 'purchase' THEN 'goal' ELSE 'other' END AS kind, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' ELSE 'flat' END AS direction FROM t),
c AS (SELECT *, round(coalesce(CASE direction WHEN 'up' THEN ups WHEN 'down' THEN downs ELSE 0 END / nullif(samples - 1, 0), 0), 6) AS confidence FROM d),
r AS (SELECT user_id, event_type, rule, list_filter([CASE WHEN samples < 3 THEN 'insufficient_samples' END, CASE WHEN kind <> want OR direction <> way THEN 'rule_not_matched' END, CASE WHEN samples < 2 THEN 'upstream_trend_uncertain' END, CASE WHEN confidence < 0.6 THEN 'weak_support' END], lambda x: x IS NOT NULL) AS reasons, confidence
  FROM c, (VALUES ('increasing_constraint_pressure', 'constraint', 'up'), ('decreasing_goal_signal', 'goal', 'down')) AS v(rule, want, way))
"""


@query(_TRENDS + """SELECT user_id, event_type, rule, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'derived' ELSE 'uncertain' END AS status, CASE WHEN len(reasons) = 0 THEN 'medium' END AS severity, CASE WHEN len(reasons) = 0 THEN confidence ELSE 0.0 END AS confidence FROM r""")
def trends_at_risk(spark, sf):
    """What each risk rule says of the trend of a user's values of one type; the share of steps that go the trend's way is its confidence."""
    events, at = table(spark, sf, "events"), F.struct("ts", "event_id")
    step = F.col("value") - F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    per = events.withColumn("step", step).groupBy("user_id", "event_type").agg(
        F.count("*").alias("samples"), (F.max_by("value", at) - F.min_by("value", at)).alias("change"), F.count_if(F.col("step") > 0).alias("ups"), F.count_if(F.col("step") < 0).alias("downs")
    )
    kind = F.when(F.col("event_type") == "error", "constraint").when(F.col("event_type") == "purchase", "goal").otherwise("other")
    direction = F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("flat")
    same = F.when(F.col("change") > 0, F.col("ups")).when(F.col("change") < 0, F.col("downs")).otherwise(0)
    confidence = F.round(F.coalesce(same / F.nullif(F.col("samples") - 1, F.lit(0)), F.lit(0.0)), 6)
    trends = per.select("user_id", "event_type", kind.alias("kind"), direction.alias("direction"),
        F.when(F.col("samples") > 1, "derived").otherwise("uncertain").alias("status"), "samples", F.col("samples").alias("evidence"), confidence.alias("confidence"))
    judged = None
    for rule in gates.RISKS:
        part = gates.risk(trends, rule).withColumn("rule", F.lit(rule))
        judged = part if judged is None else judged.unionByName(part)
    return judged.select("user_id", "event_type", "rule", F.array_join("reasons", ",").alias("reasons"), F.col("risk_status").alias("status"), "severity", F.col("risk_confidence").alias("confidence"))


_GOALS = """
WITH q AS (SELECT l_orderkey, round(1 - 4 * avg(l_discount), 6) AS confidence FROM lineitem GROUP BY l_orderkey),
g0 AS (SELECT o_orderkey AS goal_id, ['career', 'project', 'health', 'finance', 'learning'][substr(o_orderpriority, 1, 1)::INTEGER] AS domain, lower(c_mktsegment || strftime(o_orderdate, ' %Y-%m')) AS target, confidence, o_orderdate AS observed_at,
  o_orderdate + INTERVAL 120 DAY AS valid_to, o_orderstatus = 'P' AS unresolved, c_acctbal < 0 AS sensitive FROM orders JOIN customer ON o_custkey = c_custkey JOIN q ON l_orderkey = o_orderkey),
c AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS goal_id, CASE l_returnflag WHEN 'R' THEN 'time' WHEN 'A' THEN 'energy' ELSE 'budget' END AS type, l_suppkey AS resource_id, l_quantity AS amount, l_shipdate AS start, l_shipdate + INTERVAL 3 DAY AS finish, l_linestatus = 'F' AS declared FROM lineitem),
f AS (SELECT g0.goal_id, coalesce(CASE WHEN observed_at > TIMESTAMP '1998-08-02 12:00:00' THEN 'future_observation' WHEN valid_to <= TIMESTAMP '1998-08-02 12:00:00' THEN 'expired_input' WHEN unresolved THEN 'unresolved_source_conflict'
  WHEN sensitive OR domain IN ('health', 'finance', 'relationship') AND confidence < 0.75 THEN 'sensitive_or_insufficient' END, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.goal_id = g0.goal_id AND type = 'budget' AND NOT declared) THEN 'undeclared_financial_resource' END) AS reason FROM g0),
g AS (SELECT * FROM g0 WHERE goal_id NOT IN (SELECT goal_id FROM f WHERE reason IS NOT NULL)),
k AS (SELECT a.goal_id AS a, b.goal_id AS b, count(*) AS resources, min(least(x.confidence, y.confidence)) AS confidence FROM c a JOIN c b ON a.type = b.type AND a.resource_id = b.resource_id AND a.goal_id < b.goal_id AND a.start < b.finish AND b.start < a.finish AND a.amount + b.amount > 60
  JOIN g x ON x.goal_id = a.goal_id JOIN g y ON y.goal_id = b.goal_id GROUP BY ALL)
"""


def _goals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as goals, their lines as claims on suppliers, and what is wrong with them."""
    orders, customer, lines = (table(spark, sf, n) for n in ("orders", "customer", "lineitem"))
    sure = lines.groupBy("l_orderkey").agg(F.round(1 - 4 * F.avg("l_discount"), 6).alias("confidence"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(sure, F.col("o_orderkey") == F.col("l_orderkey"))
    domain = F.element_at(F.array(*[F.lit(d) for d in ("career", "project", "health", "finance", "learning")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    one = lambda c: F.lit("1").alias(c)
    goals = rows.select(
        F.col("o_orderkey").alias("goal_id"), domain.alias("domain"), F.concat("c_mktsegment", F.date_format("o_orderdate", " yyyy-MM")).alias("target"), "confidence", F.col("o_orderdate").cast("timestamp").alias("observed_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 120 DAYS")).cast("timestamp").alias("valid_to"), (F.col("o_orderstatus") == "P").alias("unresolved"), (F.col("c_acctbal") < 0).alias("sensitive"), one("snapshot"), one("run"),
    )
    kind = F.when(F.col("l_returnflag") == "R", "time").when(F.col("l_returnflag") == "A", "energy").otherwise("budget")
    claims = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.col("l_orderkey").alias("goal_id"), kind.alias("type"), F.col("l_suppkey").cast("string").alias("resource_id"), F.lit("pieces").alias("unit"), F.col("l_quantity").alias("amount"),
        F.lit(60.0).alias("capacity"), F.col("l_shipdate").cast("timestamp").alias("start"), (F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS")).cast("timestamp").alias("end"), (F.col("l_linestatus") == "F").alias("declared"), one("snapshot"), one("run"),
    )
    return goals, claims, materialize(coordination.faults(goals, claims, F.lit(noise.instant(_AS_OF))))


@query(_GOALS + "SELECT goal_id, reason FROM f WHERE reason IS NOT NULL")
def goals_abstained(spark, sf):
    """Goals that can't be coordinated, and why."""
    return _goals(spark, sf)[2]


@query(_GOALS + "SELECT a, b, resources, confidence FROM k")
def goals_conflicting(spark, sf):
    """Pairs of goals that want too much of a resource at one time."""
    goals, claims, wrong = _goals(spark, sf)
    return coordination.conflicts(goals.join(wrong, "goal_id", "left_anti"), claims, days=3)


@query(_GOALS + """, w AS (SELECT target, domain, count(*) AS n, min(goal_id) AS first, min(confidence) AS confidence FROM g GROUP BY ALL),
t AS (SELECT target, min(first) AS first, sum(n)::BIGINT AS goals, count(*) AS domains, sum(n * n) AS squares, min(confidence) AS confidence FROM w GROUP BY target HAVING count(*) > 1),
z AS (SELECT x.target, count(*) AS lost FROM k JOIN g x ON x.goal_id = k.a JOIN g y ON y.goal_id = k.b AND x.target = y.target AND x.domain <> y.domain GROUP BY x.target)
SELECT target, first, goals, domains, ((goals * goals - squares) // 2 - coalesce(lost, 0))::BIGINT AS pairs, confidence FROM t LEFT JOIN z USING (target) WHERE (goals * goals - squares) // 2 > coalesce(lost, 0)""")
def goals_sharing_targets(spark, sf):
    """Targets that goals of several domains share, with how many pairs of them don't conflict."""
    goals, claims, wrong = _goals(spark, sf)
    usable = materialize(goals.join(wrong, "goal_id", "left_anti"))
    return coordination.opportunities(usable, coordination.conflicts(usable, claims, days=3)).drop("snapshot", "run")
