"""Conversations written as logs of every family, and read back through the adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.registry import query
from sparkloom.sources import logs
from sparkloom.sources.shared import shared_dir
from sparkloom.sources.tables import table

NAMES = [*logs.FAMILIES]
#: Log files that the conversations of a family are dealt over.
FILES = 8


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation in a log file of one family, by its number; files go through Spark's own text writer and reader."""
    rows = table(spark, sf, "conversations").withColumn("family", F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("conv_id") % len(NAMES) + 1).cast("int")))
    s = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    m = F.concat(s, F.lit("-m"), F.col("turn").cast("string"))
    t = F.concat(F.lit("t"), F.floor(F.col("turn") / 2).cast("string"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1700000000) + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    user = F.col("role") == "user"
    record = lambda **c: F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in c.items()]))
    text, none = F.col("text"), F.lit(None).cast("string")
    written = {
        "codex": F.when(user, record(type="turn_context", session_id=s, turn_id=t, timestamp=stamp, prompt=text)).otherwise(record(type="response_item",
            session_id=s, turn_id=t, item_id=m, role="assistant", content=text, timestamp=stamp)),
        "copilot": F.when(user, record(type="tool_execution_start", session_id=s, turn_id=t, tool_id=t, name="edit",
            timestamp=stamp)).otherwise(record(type="tool_execution_complete", session_id=s, turn_id=t, tool_id=t, timestamp=stamp)),
        "pi": F.when(F.col("turn") == 3, record(type="compaction", conversation_id=s, message_id=m, summary=text, firstKeptEntryId=F.concat(s, F.lit("-m2")),
            timestamp=stamp)).when(user, record(type="user_message", conversation_id=s, message_id=m, content=text, role="user",
            timestamp=stamp)).otherwise(record(type="assistant_message", conversation_id=s, message_id=m, content=text, role="assistant", timestamp=stamp)),
        "kimi": F.when(user, record(type="user_prompt", session_id=s, task_id=t, message_id=m, content=text,
            timestamp=stamp)).otherwise(record(type="assistant_message", session_id=s, task_id=t, message_id=m, content=text, timestamp=stamp)),
        "workbuddy": record(type="message", session_id=s, message_id=m, role=F.col("role"), content=text, timestamp=stamp),
        "grok": F.when(F.col("turn") == 2, record(type="chat_compaction", chat_id=s, id=m, summary=text, timestamp=stamp)).otherwise(record(type="chat_message",
            chat_id=s, id=m, role=F.col("role"), text=text, timestamp=stamp)),
        "blocks": record(type=F.col("role"), uuid=m, parentUuid=F.when(F.col("turn") > 0,
            F.concat(s, F.lit("-m"), (F.col("turn") - 1).cast("string"))).otherwise(none), sessionId=s, timestamp=stamp,
            content=F.array(F.struct(F.lit("thinking").alias("type"), F.lit("so").alias("thinking"), none.alias("text")),
            F.struct(F.lit("text").alias("type"), none.alias("thinking"), text.alias("text")))),
    }
    value = F.coalesce(*[F.when(F.col("family") == n, v) for n, v in written.items()])
    folder = shared_dir(spark)
    log = F.concat_ws("-", "family", (F.col("conv_id") % FILES).cast("string")).alias("log")
    heads = rows.where("family = 'pi'").select(log, "conv_id", F.lit(-1).cast("long").alias("turn"), record(type="conversation", id=s, title="session").alias("value")).distinct()
    rows.select(log, "conv_id", "turn", value.alias("value")).unionByName(heads).repartition("log").sortWithinPartitions("log", "conv_id",
        "turn").drop("conv_id", "turn").write.partitionBy("log").text(folder)
    lines = logs.read_lines(spark, f"{folder}/log=*")
    return lines.withColumn("artifact", F.regexp_extract("artifact", r"log=([^/]+)/", 1))


BASE = "WITH c AS (SELECT *, ['" + "', '".join(NAMES) + f"'][1 + conv_id % {len(NAMES)}] AS family, turn // 2 AS t, count(*) OVER (PARTITION BY conv_id, turn // 2) AS per_turn, max(turn) OVER (PARTITION BY conv_id) AS last, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) "


@query(BASE + """, e AS (SELECT family, CASE WHEN family = 'copilot' THEN CASE WHEN role = 'user' THEN 'tool_call' ELSE 'tool_result' END WHEN family = 'pi' AND turn = 3 OR family = 'grok' AND turn = 2 THEN 'compaction_summary' WHEN role = 'user' THEN 'user_message' WHEN family = 'blocks' AND role = 'system' THEN 'system' ELSE 'assistant_message' END AS kind,
CASE WHEN family = 'copilot' THEN CASE WHEN role = 'user' THEN 4 ELSE 0 END ELSE length(text) END AS chars, conv_id FROM c UNION ALL SELECT family, 'reasoning', 2, conv_id FROM c WHERE family = 'blocks' UNION ALL SELECT DISTINCT family, 'session_start', 7, conv_id FROM c WHERE family = 'pi')
SELECT family, kind, count(*) AS n, count(DISTINCT conv_id) AS sessions, sum(chars)::BIGINT AS chars FROM e GROUP BY ALL""")
def logs_adapted(spark, sf):
    """Events of all families by kind, from files whose family is found by their records."""
    events = logs.adapt_all(_lines(spark, sf))
    return events.groupBy("family", "kind").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"), F.sum(F.char_length("text")).alias("chars"))


@query(BASE + """, u AS (SELECT conv_id, family, t, count(*) FILTER (role = 'user') AS calls, count(*) FILTER (role <> 'user') AS results, count(*) AS n FROM c GROUP BY ALL),
k AS (SELECT conv_id, family, max(pos) FILTER (turn = CASE family WHEN 'pi' THEN 3 ELSE 2 END) AS p, max(pos) FILTER (turn = 2) AS kept FROM c WHERE family IN ('pi', 'grok') GROUP BY ALL),
r AS (SELECT family, 'call_result' AS kind, calls * results AS n FROM u WHERE family = 'copilot' UNION ALL SELECT family, 'turn_membership', n - 1 FROM u WHERE family IN ('codex', 'copilot', 'kimi')
UNION ALL SELECT family, 'parent', 2 FROM c WHERE family = 'blocks' AND turn > 0 AND (conv_id, turn - 1) IN (SELECT (conv_id, turn) FROM c)
UNION ALL SELECT family, 'compacted_range', CASE WHEN family = 'pi' THEN coalesce(kept, p) + 1 ELSE p END FROM k WHERE p IS NOT NULL UNION ALL SELECT family, 'retained_from', p - kept FROM k WHERE family = 'pi' AND p IS NOT NULL AND kept IS NOT NULL)
SELECT family, kind, sum(n)::BIGINT AS n FROM r GROUP BY ALL HAVING sum(n) > 0""")
def logs_relations(spark, sf):
    """Relations between the events of all families by kind."""
    events = logs.adapt_all(_lines(spark, sf))
    found = logs.relations(events)
    return found.join(events.select(F.col("event").alias("source"), "family"), "source").groupBy("family", "kind").agg(F.count("*").alias("n"))


def _nested_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation as an export of its own, whose records hold their fields under a payload and name the session once."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    s = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    t = F.concat(F.lit("t"), F.floor(F.col("turn") / 2).cast("string"))
    call = F.concat(F.lit("x"), F.col("turn").cast("string"))
    chars = F.char_length("text")
    record = lambda kind, **payload: F.to_json(F.struct(F.lit(kind).alias("type"),
        F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in payload.items()]).alias("payload")))
    blocks = lambda kind, c: F.array(F.struct(F.lit(kind).alias("type"), c.alias("text")))
    role = F.when(F.col("role") == "system", "developer").otherwise(F.col("role"))
    message = record("response_item", type="message", id=F.concat(F.lit("m"), F.col("turn").cast("string")), role=role, content=blocks("input_text", F.col("text")))
    asked = F.array(record("turn_context", turn_id=t, model="m"), message)
    answered = F.array(
        record("response_item", type="function_call", name="count", call_id=call, turn_id=t, arguments=F.concat(F.lit('{"of": '), F.col("turn").cast("string"), F.lit("}"))),
        record("response_item", type="function_call_output", call_id=call, output=blocks("output_text", chars.cast("string"))),
        message,
        record("event_msg", type="token_count", info=F.struct(F.struct(chars.alias("input_tokens"), F.lit(1).alias("output_tokens")).alias("last_token_usage"))),
    )
    values = F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", answered).otherwise(F.array(message))
    heads = rows.select("conv_id").distinct().select(s.alias("artifact"), F.lit(-1).cast("long").alias("turn"), F.lit(0).alias("i"), record("session_meta", id=s, cwd="/").alias("value"))
    lines = rows.select(s.alias("artifact"), "turn", F.posexplode(values).alias("i", "value")).unionByName(heads)
    return lines.select("artifact", F.struct("turn", "i").alias("place"), "value")


_NESTED = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, turn // 2 AS t FROM conversations),
e AS (
  SELECT DISTINCT 'session_start' AS kind, conv_id, NULL::BIGINT AS turn, NULL::BIGINT AS t, 0 AS chars FROM c
  UNION ALL SELECT 'turn_boundary', conv_id, turn, t, 0 FROM c WHERE role = 'user'
  UNION ALL SELECT CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'developer_message' END, conv_id, turn, NULL, length(text) FROM c
  UNION ALL SELECT 'tool_call', conv_id, turn, t, 8 + length(turn::VARCHAR) FROM c WHERE role = 'assistant'
  UNION ALL SELECT 'tool_result', conv_id, turn, NULL, length(length(text)::VARCHAR) FROM c WHERE role = 'assistant'
  UNION ALL SELECT 'usage', conv_id, turn, NULL, length('input_tokens=' || length(text) || ' output_tokens=1') FROM c WHERE role = 'assistant'
)
"""


@query(_NESTED + "SELECT kind, count(*) AS n, count(DISTINCT conv_id) AS sessions, sum(chars)::BIGINT AS chars FROM e GROUP BY kind")
def logs_nested(spark, sf):
    """Events of nested exports by kind; the session, which only the first record names, reaches all of them."""
    events = logs.adapt_all(_nested_lines(spark, sf))
    return events.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"), F.sum(F.char_length("text")).alias("chars"))


@query(_NESTED + """, g AS (SELECT conv_id, t, count(*) AS n FROM e WHERE t IS NOT NULL GROUP BY ALL), k AS (SELECT conv_id, turn, count(*) FILTER (kind = 'tool_call') * count(*) FILTER (kind = 'tool_result') AS n FROM e GROUP BY ALL)
SELECT 'call_result' AS kind, sum(n)::BIGINT AS n FROM k HAVING sum(n) > 0 UNION ALL SELECT 'turn_membership', sum(n - 1)::BIGINT FROM g HAVING sum(n - 1) > 0""")
def logs_nested_relations(spark, sf):
    """Calls with results, and turns with their members, in nested exports."""
    return logs.relations(logs.adapt_all(_nested_lines(spark, sf))).groupBy("kind").agg(F.count("*").alias("n"))


#: Turns of a session folder at most, so that a long conversation is several folders and no file is unbounded.
FOLDER = 50


@query(f"""
WITH c AS (SELECT conv_id, turn // {FOLDER} AS part, turn, role, coalesce(text, '') AS text FROM conversations),
f AS (SELECT conv_id, part, count(*) FILTER (role IN ('user', 'assistant')) AS plain FROM c GROUP BY ALL),
e AS (
  SELECT 'session_start' AS kind, conv_id, part, 0 AS chars FROM f UNION ALL SELECT 'compaction_summary', conv_id, part, length('part ' || part) FROM f UNION ALL SELECT 'compaction_summary', conv_id, part, 5 FROM f UNION ALL SELECT 'subagent', conv_id, part, 6 FROM f
  UNION ALL SELECT CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'unknown' END, conv_id, part, length(text) FROM c
)
SELECT kind, count(*) AS n, count(DISTINCT (conv_id, part)) AS sessions, sum(chars)::BIGINT AS chars FROM e GROUP BY kind
UNION ALL SELECT 'relation:compacted_range', count(*), count(*), 0 FROM f UNION ALL SELECT 'relation:source_session_crosswalk', count(*), count(*), 0 FROM f
""")
def logs_folders(spark, sf):
    """Events and relations of sessions kept as folders of several files."""
    rows = table(spark, sf, "conversations").withColumn("part", F.floor(F.col("turn") / FOLDER).cast("string"))
    folder = F.concat_ws("/", F.lit("/sessions"), F.concat_ws("-", F.col("conv_id").cast("string"), "part"))
    line = F.to_json(F.struct("role", F.coalesce("text", F.lit("")).alias("content"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id")))
    per = rows.groupBy(folder.alias("folder"), "part").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    summary = F.to_json(F.struct(F.struct(F.col("folder").alias("id")).alias("info"), F.concat(F.lit("part "), "part").alias("session_summary")))
    file = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    files = per.select("folder", F.explode(F.array(file("summary.json", summary), file("chat_history.jsonl", F.array_join(F.col("lines.line"), "\n")),
        file("recap.md", F.lit("recap")), file("subagents.json", F.lit('[{"name": "helper"}]')))).alias("f"))
    events = logs.directory_events(files.select("folder", "f.name", "f.value"))
    kinds = events.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"), F.sum(F.char_length("text")).alias("chars"))
    related = logs.directory_relations(events).groupBy(F.concat(F.lit("relation:"), "kind").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.unionByName(related.select("kind", "n", F.col("n").alias("sessions"), F.lit(0).cast("long").alias("chars")))
