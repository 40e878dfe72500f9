"""The registered query of each corpus operator, with production parameters over whole tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, decontaminate, hard_negatives, near_dedup, neighbours, packing, quality_classifier, quality_rules, secret_scan, suffix_array, url_filter, warc, whitening


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_array.remove_repeats(_read(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# Host, path and action of the production rules.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES) + " AS rules(host, path, action)")
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), rules, default="allow")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(_read(spark, sf_dir, "pages"), least_bytes=0)
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    back = chat_format.read_back(chat_format.format_chats(chat_format.conversation_events(given.unionByName(extra))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    known = _read(spark, sf_dir, "labels").where(~_held_out())
    model = quality_classifier.train(quality_rules.labelled_rows(docs, known), quality_rules.labelled_rows(docs, known, quality_classifier.FIT_ROWS))
    scored = quality_classifier.score_texts(docs, model)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("judged", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    count = lambda kind: F.size(F.filter("judged", lambda s: s["kind"] == kind)).cast("long")
    return judged.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(secret_scan.reported(F.col("judged")), written), ",").alias("spans"),
        F.size(F.filter("judged", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(quality_rules.labelled_rows(docs, _read(spark, sf_dir, "labels"), quality_rules.FIT_ROWS))
    q = quality_rules.measure_and_score(docs, model)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in columns])


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(_read(spark, sf_dir, "embeddings"), components=16)
    shares = [float(e / model.trace) for e in model.variances]
    explained = F.element_at(F.array(*[F.lit(s) for s in shares] or [F.lit(None).cast("double")]), F.col("component"))
    return rows.select(F.col("id").alias("vec_id"), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(_read(spark, sf_dir, "embeddings"), lambda id: id % 100 == 0, k=10)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.labelled_rows(_read(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.materialize(rows.withColumn("label", moved))
    return hard_negatives.hard_negatives(rows, rows.where("id % 50 = 0"), k=3, n_positives=5, low=50, high=95)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    corpus = (op1_best_fit_packing, op2_suffix_array_dedup, op3_url_filters, op4_minhash_near_dedup, op5_warc, op6_chat_formatting, op7_benchmark_decontamination, op8_quality_classifier, op9_secret_scans, op10_quality_rules)
    vectors = (op11_embedding_whitening, op12_nearest_neighbours, op13_hard_negatives)
    return {f.__name__: f for f in corpus + vectors}


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(rule_host, rule_path, action)
), best AS (
  SELECT host, path, arg_max(struct_pack(rule := rule_host || rule_path, action := action), length(rule_host || rule_path)) AS b
  FROM (SELECT DISTINCT host, path FROM s) d
  JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, b.rule AS rule, coalesce(b.action, 'allow') AS verdict
FROM s LEFT JOIN best USING (host, path)
"""

OP5_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS digest, max(page_id) OVER (PARTITION BY sha1(body)) AS last FROM p
), bits AS (
  SELECT DISTINCT digest, list_aggregate(list_transform(range(0, 160), lambda i: CAST((CAST('0x' || substr(digest, i // 4 + 1, 1) AS INTEGER) >> (3 - i % 4)) & 1 AS VARCHAR)), 'string_agg', '') AS b FROM d
), b32 AS (
  SELECT digest, list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda k: CAST(substr(b, 5 * j + k + 1, 1) AS INTEGER) * CAST(power(2, 4 - k) AS INTEGER))) AS INTEGER), 1)), 'string_agg', '') AS payload_digest FROM bits
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d JOIN b32 USING (digest)
"""

OP6_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + length(text)
    + length(regexp_replace(role, '[^<\[\\\n]', '', 'g')) + length(regexp_replace(text, '[^<\[\\]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""

#: The words of a text, and what op4 says of them, for the SQL of small tables: all pairs that share a shingle.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\f\r]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM w
), kinds AS (
  SELECT list_sort(shingles) AS shingles, min(doc_id) AS id FROM s WHERE len(shingles) > 0 GROUP BY 1
), e AS (
  SELECT id, len(shingles) AS n, unnest(shingles) AS shingle FROM kinds
), links AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT id, id AS other FROM kinds UNION SELECT reach.id, both_.b FROM reach JOIN both_ ON reach.other = both_.a
), comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id, s.doc_id = coalesce(c.component, s.doc_id) AS kept
FROM s LEFT JOIN kinds k ON list_sort(s.shingles) = k.shingles LEFT JOIN comp c ON c.id = k.id
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT rid, c, substr(h, 2 * c + 1, 1398) AS piece FROM (SELECT rid, unnest(range(0, length(h) // 2 - 199, 500)) AS c, h FROM d WHERE length(h) >= 400)
), g AS (
  SELECT rid, c + i AS i, md5(substr(piece, 2 * i + 1, 400)) AS m FROM (SELECT rid, c, unnest(range(0, length(piece) // 2 - 199)) AS i, piece FROM p)
), r AS (
  SELECT rid, i FROM g WHERE m IN (SELECT m FROM g GROUP BY m HAVING count(*) > 1)
), o AS (
  SELECT rid, i, CASE WHEN i > lag(i) OVER w + 200 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY rid ORDER BY i)
), n AS (
  SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM o
), spans AS (
  SELECT rid, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY rid, run
), gaps AS (
  SELECT rid, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY rid ORDER BY a)
  UNION ALL SELECT rid, max(b), NULL FROM spans GROUP BY rid
), kept AS (
  SELECT gaps.rid, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a, coalesce(b, length(h))) AS h FROM gaps JOIN d ON d.rid = gaps.rid GROUP BY gaps.rid
), sums AS (
  SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid
)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.rid = d.rid LEFT JOIN kept ON kept.rid = d.rid
"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, group before the match that is none of it, group of the value, least length of the value.
_SPANS = (
    ("assign", _ASSIGN, 0, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", "[0-9a-f]+", 0, 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 0, 1),
    ("jwt", r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 2, 1),
    ("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", 0, 0, 1),
)


def _spans_sql() -> str:
    """Every match of every kind with its place: matches are put between marks, and what lies before them is counted."""
    parts = []
    for order, (kind, pattern, lead, group, least) in enumerate(_SPANS):
        marked = f"regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(2), 'g')"
        pieces = f"SELECT rid, text, unnest(string_split({marked}, chr(1))) AS piece, generate_subscripts(string_split({marked}, chr(1)), 1) AS n FROM d"
        placed = f"SELECT rid, text, n, split_part(piece, chr(2), 1) AS hit, coalesce(sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY rid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM ({pieces})"
        found = f"SELECT rid, text, {order} AS o, '{kind}' AS kind, at_ + length(regexp_extract(hit, '{pattern}', {lead})) * {int(lead > 0)} AS s, at_ + length(hit) AS e, regexp_extract(hit, '{pattern}', {group}) AS v FROM ({placed}) WHERE n > 1"
        parts.append(f"SELECT * FROM ({found}) WHERE length(v) >= {least}")
    return " UNION ALL ".join(parts)


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce('.' || source, '') AS owner FROM documents
), f AS ({_spans_sql()}
), held AS (
  SELECT v, md5(f.text) AS t, min(owner) AS owner FROM f JOIN d ON d.rid = f.rid GROUP BY ALL
), owners AS (
  SELECT v, count(DISTINCT owner) AS n FROM held GROUP BY v
), j AS (
  SELECT rid, o, kind, s, e, owners.n < {secret_scan.SHARED_BY} AND NOT ({" OR ".join(f"contains(lower(f.v), '{p}')" for p in secret_scan.PLACEHOLDERS)}) AS live FROM f JOIN owners ON owners.v = f.v
), g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3 OR live) AS spans
  FROM j GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g ON g.rid = d.rid
"""


OP13_SQL = """
WITH sound AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), r AS (
  SELECT id, CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(v, lambda c: CAST(floor(256 * c) AS BIGINT)) AS x
  FROM sound WHERE len(v) = (SELECT len(v) FROM sound GROUP BY len(v) ORDER BY count(*) DESC, len(v) LIMIT 1)
), s AS (
  SELECT a.id AS a, r.id AS b, a.label = r.label AS same, CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r ON a.id <> r.id WHERE a.id % 50 = 0
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_hard_negatives": OP13_SQL} | {"op2_suffix_array_dedup": OP2_SQL, "op3_url_filters": OP3_SQL, "op4_minhash_near_dedup": OP4_SQL, "op5_warc": OP5_SQL, "op6_chat_formatting": OP6_SQL, "op9_secret_scans": OP9_SQL}
