"""Documents, conversations and events as knowledge units: identities, tokens, classes and times of every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import identity, tokens
from sparkloom.registry import query
from sparkloom.sources.tables import table

TOOLS = ["The", "bash", "grep", "tion", "git"]


@query("""
SELECT doc_id,
  substr(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), 1, 60) AS short,
  sha256('source|' || lower(source)) AS entity,
  'cu|' || substr(sha256(source || '|' || lang || '|' || substr(sha256(text), 1, 16)), 1, 32) AS unit,
  sha256('ev|docs|1|' || source || '|' || doc_id) AS event,
  sha256('ev|docs|1|' || source || '|doc|' || lang) AS event_by_session,
  substr(sha256(source || '|' || lang || '|' || doc_id || '|' || n_chars || '|c'), 1, 32) AS cache_key,
  sha256(lang || '|' || source || '|' || substr(lower(trim(text)), 1, 120)) AS repeat_key,
  list_filter([CASE WHEN contains(lower(text), 'the') THEN 'The' END, CASE WHEN contains(lower(text), 'bash') THEN 'bash' END, CASE WHEN contains(lower(text), 'git') THEN 'git' END,
    CASE WHEN contains(lower(text), 'grep') THEN 'grep' END, CASE WHEN contains(lower(text), 'tion') THEN 'tion' END], lambda x: x IS NOT NULL) AS tools,
  CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 80) || '...[truncated]' END AS material
FROM documents""")
def docs_identities(spark, sf):
    """Stable ids and keys of every document."""
    rows = table(spark, sf, "documents")
    none, lit = F.lit(None).cast("string"), F.lit
    native = F.col("doc_id").cast("string")
    return rows.select(
        "doc_id",
        identity.short(F.col("text"), 60).alias("short"),
        identity.entity_id(lit("source"), F.col("source")).alias("entity"),
        identity.canonical_id(F.col("source"), F.col("lang"), F.col("text")).alias("unit"),
        identity.event_id(lit("docs"), lit("1"), F.col("source"), native, lit("doc"), none, none).alias("event"),
        identity.event_id(lit("docs"), lit("1"), F.col("source"), none, lit("doc"), F.col("lang"), none).alias("event_by_session"),
        identity.cache_key(F.col("source"), F.col("lang"), F.col("doc_id"), F.col("n_chars"), lit("c")).alias("cache_key"),
        F.sha2(identity.repeat_key(F.col("lang"), F.col("source"), F.col("text")), 256).alias("repeat_key"),
        identity.tools_named(F.col("text"), TOOLS).alias("tools"),
        identity.marked_cut(F.col("text"), 80).alias("material"),
    )


@query("""
WITH t AS (
  SELECT doc_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS latin,
    list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_\\-]{3,}')) AS words,
    list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.\\\\/-]{3,}'), lambda w: regexp_replace(lower(w), '^[.\\\\/_-]+|[.\\\\/_-]+$', '', 'g')), lambda w: w <> '')) AS needles
  FROM documents
)
SELECT doc_id,
  list_sort(list_filter(latin, lambda w: w NOT IN ('query', 'case', 'content', 'private', 'answer', 'data', 'user', 'no', 'the', 'has', 'what', 'with', 'from', 'about'))) AS retrieval_tokens,
  list_transform(list_sort(list_transform(words, lambda w: struct_pack(n := -length(w), t := w)))[1:4], lambda x: x.t) AS query_tokens,
  len(needles)::INTEGER AS n_needles,
  sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')))) AS review_hash
FROM t""")
def docs_retrieval_tokens(spark, sf):
    """What retrieval and review look for in every document."""
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        tokens.retrieval_tokens(text).alias("retrieval_tokens"),
        tokens.query_tokens(text).alias("query_tokens"),
        F.size(tokens.needles(text)).alias("n_needles"),
        F.sha2(F.trim(tokens.review_text(text)), 256).alias("review_hash"),
    )


@query("""
WITH w AS (
  SELECT conv_id, turn, role, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS toks, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations
), p AS (
  SELECT *, list_distinct(regexp_extract_all(lower(coalesce(reply, '')), '[a-z0-9_]{2,}')) AS other, trim(text) AS t FROM w
)
SELECT conv_id, turn,
  regexp_matches(text, '^(\\[Bash\\]|\\[Tool:|\\[Thinking\\]|\\[Read\\]|\\[Edit\\]|\\[Write\\]|\\[Grep\\]|\\[Glob\\]|\\[TodoWrite\\]|\\[Agent\\]|\\[WebFetch\\]|\\[WebSearch\\]|\\[Skill\\]|\\[Task\\]\\s*\\{)') AS tool_message,
  contains(lower(text), 'this session is being continued from a previous conversation') AS compact_summary,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(no,|(wrong|incorrect|actually)($|[^\\p{L}\\p{N}_]))') THEN 'corrected'
    WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(works|worked|thanks|thank you|perfect|great)($|[^\\p{L}\\p{N}_])') THEN 'adopted' ELSE 'none' END AS confirmation,
  t = '' OR (length(t) < 30 AND regexp_matches(t, '(?i)^(ok(ay)?|yes|y|continue|go on|thanks?)[\\s!~.]*$')) AS nod,
  replace(replace(replace(substr(text, 1, 40), '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped,
  round(CASE WHEN len(toks) = 0 OR len(other) = 0 THEN 0 ELSE len(list_intersect(toks, other)) / (len(toks) + len(other) - len(list_intersect(toks, other)))::DOUBLE + least(len(list_intersect(toks, other)), 8) * 0.01 END, 6) AS reply_score,
  round(greatest(0, least(1, CASE WHEN regexp_matches(text, '[？?].{2,}') THEN 0.25 ELSE 0 END + CASE WHEN length(text) BETWEEN 20 AND 280 THEN 0.15 ELSE 0 END + 0.15 + 0.10
    - CASE WHEN regexp_matches(text, '[{};]|def |class |import |function |SELECT |http') THEN 0.15 ELSE 0 END - CASE WHEN regexp_matches(text, 'Prompted |Attached |rollout-|Assistant Rules|InvalidTemplate') THEN 0.20 ELSE 0 END
    - CASE WHEN length(text) > 800 THEN 0.15 ELSE 0 END)), 3)::DOUBLE AS answerability
FROM p""".replace("'\\'", "chr(92)").replace("'\\\\'", "chr(92) || chr(92)"))
def messages_markers(spark, sf):
    """Signs on every message: tool output, summary, confirmation, and how far the next message takes it up."""
    from pyspark.sql import Window

    text = F.col("text")
    rows = table(spark, sf, "conversations").withColumn("reply", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    score = tokens.pair_score(tokens.review_tokens(text), tokens.review_tokens(F.col("reply")))
    return rows.select(
        "conv_id", "turn",
        tokens.is_tool_message(text).alias("tool_message"),
        tokens.is_compact_summary(text).alias("compact_summary"),
        tokens.confirmation(text).alias("confirmation"),
        tokens.short_confirmation(text).alias("nod"),
        tokens.like_escaped(F.substring("text", 1, 40)).alias("escaped"),
        F.round(score, 6).alias("reply_score"),
        tokens.answerability(text, F.lit(None).cast("double"), F.col("role"), F.col("role")).alias("answerability"),
    )


@query("""
SELECT event_id,
  strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) // 1000 % 1000 <> 0 THEN '.' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') ELSE '' END || 'Z' AS from_millis,
  strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || 'Z' AS from_zone,
  CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m') WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m') ELSE '未知' END AS month,
  hour(ts) * 60 + minute(ts) >= 1350 OR hour(ts) * 60 + minute(ts) < 375 AS quiet,
  hour(ts + INTERVAL 8 HOUR) * 60 + minute(ts + INTERVAL 8 HOUR) BETWEEN 540 AND 1049 AS at_work_in_shanghai
FROM events""")
def events_time_forms(spark, sf):
    """Times in several notations brought to one; quiet and working hours, also in another zone."""
    ts = F.col("ts").cast("timestamp")
    local = F.from_utc_timestamp(ts, "Asia/Shanghai")
    return table(spark, sf, "events").select(
        "event_id",
        identity.utc_time(F.unix_millis(ts).cast("string")).alias("from_millis"),
        identity.utc_time(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).alias("from_zone"),
        identity.month_of(F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd")), F.when(F.col("event_id") % 3 == 1, F.date_format(ts, " yyyy-MM-dd HH:mm"))).alias("month"),
        identity.in_window(ts, "22:30", "06:15").alias("quiet"),
        identity.in_window(local, "09:00", "17:30").alias("at_work_in_shanghai"),
    )


@query("""
SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS started, strftime(max(ts), '%Y-%m-%d') AS ended, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS days, list_sort(list(DISTINCT strftime(ts, '%Y-%m'))) AS months
FROM events GROUP BY user_id""")
def events_time_windows(spark, sf):
    """The days that each user's events span, and their months."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    span = F.timestamp_diff("DAY", F.min("ts"), F.max("ts"))
    return table(spark, sf, "events").groupBy("user_id").agg(day(F.min("ts")).alias("started"), day(F.max("ts")).alias("ended"), span.alias("days"),
        F.array_sort(F.collect_set(F.date_format("ts", "yyyy-MM"))).alias("months"))


@query("""
WITH j AS (
  SELECT event_id, event_type, user_id, json_extract_string(props, '$.k') AS k FROM events
), c AS (
  SELECT event_id, '{"event":"' || event_type || '","items":[' || user_id || ',{"a":1,"k":' || k || '}]}' AS canonical, user_id, k FROM j
)
SELECT event_id, canonical, sha256(canonical) AS checksum, canonical AS mended,
  CASE event_id % 4 WHEN 0 THEN [user_id::VARCHAR, '{"k":' || k || '}'] WHEN 1 THEN ['{"k":' || k || '}'] WHEN 2 THEN ['plain'] ELSE [] END AS items
FROM c""")
def events_canonical_json(spark, sf):
    """Properties as canonical JSON with a checksum, whatever the order of keys; lists, lone values and texts that are no JSON as lists."""
    k = F.get_json_object("props", "$.k")
    loose = F.concat(F.lit('{ "items" : [ '), F.col("user_id"), F.lit(', {"k": '), k, F.lit(', "a": 1} ],\n "event": "'), F.col("event_type"), F.lit('"}'))
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), F.col("user_id"), F.lit(", "), F.col("props"), F.lit("]"))).when(F.col("event_id") % 4 == 1,
        F.col("props")).when(F.col("event_id") % 4 == 2, F.lit("plain"))
    return table(spark, sf, "events").select("event_id", identity.canonical_json(loose).alias("canonical"), identity.json_checksum(loose).alias("checksum"),
        identity.mended_json(loose).alias("mended"), identity.json_list(raw).alias("items"))


@query("""
WITH d AS (SELECT o_orderkey, rpad((o_orderkey * 7919 + 4000000000000)::VARCHAR, 16, '7') AS digits FROM orders),
p AS (SELECT o_orderkey, digits, unnest(range(0, 16)) AS i FROM d),
s AS (SELECT o_orderkey, digits, sum(CASE WHEN i % 2 = 0 THEN substr(digits, 16 - i::INTEGER, 1)::INTEGER WHEN substr(digits, 16 - i::INTEGER, 1)::INTEGER > 4 THEN substr(digits, 16 - i::INTEGER, 1)::INTEGER * 2 - 9 ELSE substr(digits, 16 - i::INTEGER, 1)::INTEGER * 2 END) AS total FROM p GROUP BY ALL)
SELECT o_orderkey, digits, total % 10 = 0 AS valid FROM s""")
def orders_card_check(spark, sf):
    """Numbers of 16 digits that pass or fail the check of card numbers."""
    digits = F.rpad((F.col("o_orderkey") * 7919 + 4000000000000).cast("string"), 16, "7")
    return table(spark, sf, "orders").select("o_orderkey", digits.alias("digits"), identity.luhn(digits).alias("valid"))


@query("""
WITH k AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'project:p' || page_id WHEN 1 THEN 'goal:health:p' || page_id || ':walk' WHEN 2 THEN 'goal:health:' || page_id ELSE 'topic:' || page_id END AS key,
    regexp_replace(regexp_replace(url, '[\\\\/]+$', ''), '^.*[\\\\/]', '') AS stem FROM pages
)
SELECT page_id, CASE WHEN page_id % 4 < 2 THEN key END AS topic, CASE WHEN trim(stem) <> '' THEN lower(trim(stem)) END AS stem,
  'view:' || sha256('topic|g1|1|' || array_to_string(list_sort(list_distinct(['p' || page_id, 'p' || (page_id % 7), 'p' || page_id])), '|')) AS view_id
FROM k""")
def pages_topic_keys(spark, sf):
    """Topic keys that are well formed, entity names from paths, and view ids from unordered references."""
    n = F.col("page_id").cast("string")
    made = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("project%3Ap"), n)).when(F.col("page_id") % 4 == 1,
        F.concat(F.lit("goal:health:p"), n, F.lit(":walk"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("goal:health:"), n)).otherwise(F.concat(F.lit("topic:"), n))
    p = lambda c: F.concat(F.lit("p"), c.cast("string"))
    refs = F.array(p(F.col("page_id")), p(F.col("page_id") % 7), p(F.col("page_id")))
    return table(spark, sf, "pages").select("page_id", identity.topic_key(made).alias("topic"), identity.entity_stem(F.col("url")).alias("stem"),
        identity.view_id(F.lit("topic"), F.lit("g1"), F.lit("1"), refs).alias("view_id"))
