"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import folds, graph, relational
from sparkloom.registry import query
from sparkloom.sources.tables import parse_lines, table


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


@query("""WITH m AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS norm FROM conversations),
h AS (SELECT *, row_number() OVER (PARTITION BY sha256(norm) ORDER BY conv_id, turn) AS rn FROM m)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN role = 'system' THEN 'system' WHEN length(norm) <= 30 THEN 'short' WHEN rn > 1 THEN 'duplicate' ELSE 'eligible' END AS reason FROM h) GROUP BY reason""")
def messages_eligible(spark, sf):
    """How many messages each filter stops, first reason wins."""
    rows = _messages(spark, sf).withColumn("norm", text.squeezed(F.col("text")))
    rows = rows.select("role", F.char_length("norm").alias("n"), F.sha2("norm", 256).alias("h"), F.struct("conv_id", "turn").alias("at"))
    rows = rows.join(rows.groupBy("h").agg(F.min("at").alias("first")), "h")
    reason = F.when(F.col("role") == "system", "system").when(F.col("n") <= 30, "short").when(F.col("at") != F.col("first"), "duplicate").otherwise("eligible")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT a.conv_id, a.turn, u.turn AS asof_user_turn FROM (SELECT * FROM conversations WHERE role = 'assistant') a
LEFT JOIN LATERAL (SELECT turn FROM conversations u WHERE u.role = 'user' AND u.conv_id = a.conv_id AND u.turn <= a.turn ORDER BY u.turn DESC LIMIT 1) u ON true""")
def messages_prev_user_asof(spark, sf):
    rows = _messages(spark, sf)
    users = rows.where("role = 'user'").select("conv_id", "turn", F.col("turn").alias("user_turn"))
    return relational.as_of(rows.where("role = 'assistant'").select("conv_id", "turn"), users, ["conv_id"], "turn", ["user_turn"])


@query("SELECT conv_id, turn, role, next_role, length(text) AS chars, next_chars FROM (SELECT *, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn, lead(length(text)) OVER w AS next_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE next_turn = turn + 1")
def turns_adjacent(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _messages(spark, sf).withColumns({"next_role": F.lead("role").over(w), "next_turn": F.lead("turn").over(w), "next_chars": F.lead(F.char_length("text")).over(w)})
    return rows.where("next_turn = turn + 1").select("conv_id", "turn", "role", "next_role", F.char_length("text").alias("chars"), "next_chars")


@query("SELECT conv_id, turn, chars_so_far FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS chars_so_far FROM conversations) WHERE chars_so_far <= 1500")
def messages_window_budget(spark, sf):
    """The newest messages of each conversation that fit a budget of characters."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    rows = _messages(spark, sf).withColumn("chars_so_far", F.sum(F.char_length("text")).over(w))
    return rows.where("chars_so_far <= 1500").select("conv_id", "turn", "chars_so_far")


@query("""WITH RECURSIVE m AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
c AS (SELECT conv_id, rn, turn, n AS held, 1 AS chunk FROM m WHERE rn = 1 UNION ALL
SELECT m.conv_id, m.rn, m.turn, CASE WHEN c.held + m.n > 800 THEN m.n ELSE c.held + m.n END, CASE WHEN c.held + m.n > 800 THEN c.chunk + 1 ELSE c.chunk END FROM m JOIN c ON m.conv_id = c.conv_id AND m.rn = c.rn + 1)
SELECT conv_id, chunk, count(*) AS n, sum(n)::BIGINT AS chars FROM (SELECT c.conv_id, c.chunk, m.n FROM c JOIN m USING (conv_id, rn)) GROUP BY ALL""")
def messages_chunks(spark, sf):
    """Messages in order, in chunks that begin anew where a budget of characters would be exceeded."""

    def step(state, row):
        chunk, held, n = *(state or (1, 0)), row["n"] or 0
        chunk, held = (chunk + 1, n) if state and held + n > 800 else (chunk, held + n)
        return (chunk, held), (row["conv_id"], chunk, n)

    rows = _messages(spark, sf).select("conv_id", "turn", F.char_length("text").alias("n"))
    placed = folds.ordered_fold(rows, ["conv_id"], ["turn"], step, "conv_id long, chunk int, n long")
    return placed.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.sum("n").alias("chars"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, max(turn) FILTER (role = 'user') AS last_user, sum(length(text))::BIGINT AS chars, count(*) FILTER (role = 'user') >= 2 AS enough FROM conversations GROUP BY conv_id")
def conv_session_stats(spark, sf):
    user = F.col("role") == "user"
    return _messages(spark, sf).groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(user).alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"),
        F.max(F.when(user, F.col("turn"))).alias("last_user"), F.sum(F.char_length("text")).alias("chars"), (F.count_if(user) >= 2).alias("enough"),
    )


@query("""SELECT role, conv_id % 10 AS cohort, count(*) AS n, count(DISTINCT conv_id) AS convs, CASE WHEN count(*) = 0 THEN 'warn' WHEN count(DISTINCT conv_id) < 5 THEN 'info' ELSE 'ok' END AS level FROM conversations GROUP BY ALL""")
def role_coverage(spark, sf):
    rows = _messages(spark, sf).groupBy("role", (F.col("conv_id") % 10).alias("cohort")).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("convs"))
    return rows.withColumn("level", F.when(F.col("n") == 0, "warn").when(F.col("convs") < 5, "info").otherwise("ok"))


@query("SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion') AND role IN ('user', 'assistant')")
def messages_token_search(spark, sf):
    """Messages that hold all tokens of a query."""
    hit = F.lit(True)
    for token in ("the", "tion"):
        hit = hit & F.contains(F.lower("text"), F.lit(token))
    return _messages(spark, sf).where(hit & F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role")


@query("""SELECT conv_id, sum(w * (length(t) - length(replace(t, 'the', ''))) // 3)::BIGINT AS score FROM (SELECT conv_id, lower(text) AS t, CASE role WHEN 'system' THEN 3 WHEN 'user' THEN 2 ELSE 1 END AS w FROM conversations) GROUP BY conv_id HAVING score > 0 ORDER BY score DESC, conv_id LIMIT 50""")
def sessions_keyword_rank(spark, sf):
    """Conversations by field-weighted hits of a keyword."""
    weight = F.when(F.col("role") == "system", 3).when(F.col("role") == "user", 2).otherwise(1)
    rows = _messages(spark, sf).groupBy("conv_id").agg(F.sum(weight * text.occurrences(F.col("text"), "the")).alias("score"))
    return rows.where("score > 0").orderBy(F.desc("score"), "conv_id").limit(50)


@query("""WITH s AS (SELECT DISTINCT conv_id, unnest(string_split(text, '. ')) AS h FROM conversations), r AS (SELECT h FROM s WHERE length(h) >= 4 GROUP BY h HAVING count(*) BETWEEN 2 AND 20)
SELECT a.conv_id AS a, b.conv_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.conv_id < b.conv_id WHERE a.h IN (SELECT h FROM r) GROUP BY ALL""")
def sessions_shared_sentences(spark, sf):
    """Conversation pairs that share sentences which at most 20 conversations hold."""
    held = _messages(spark, sf).select("conv_id", F.explode(F.split("text", "[.] ")).alias("h")).where(F.char_length("h") >= 4).distinct()
    rare = held.groupBy("h").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 20").select("h")
    few = held.join(rare, "h")
    pairs = few.withColumnRenamed("conv_id", "a").join(few.withColumnRenamed("conv_id", "b"), "h").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("""WITH s AS (SELECT DISTINCT conv_id, unnest(string_split(text, '. ')) AS h FROM conversations)
SELECT a.conv_id AS a, b.conv_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.conv_id < b.conv_id WHERE length(a.h) >= 4 GROUP BY ALL""")
def sessions_shared_sentences_whole(spark, sf):
    """Conversation pairs that share sentences, however many conversations hold them."""
    held = _messages(spark, sf).select(F.col("conv_id").alias("a"), F.explode(F.split("text", "[.] ")).alias("b")).where(F.char_length("b") >= 4)
    return graph.common_neighbours(held).select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("n").alias("shared"))


RECORD = "type string, sessionId string, uuid string, parentUuid string, message struct<role string, content array<struct<type string, text string>>>"


@query("""SELECT 'c' || conv_id AS session_id, 'c' || conv_id || '-' || turn AS event_id, CASE WHEN turn > 0 THEN 'c' || conv_id || '-' || (turn - 1) END AS parent_id, CASE WHEN role = 'system' THEN 'compact_summary' ELSE role || '_text' END AS kind, block::INTEGER AS block, text AS content
FROM conversations, (VALUES (0), (1)) AS b(block) WHERE block = 0 OR role = 'assistant'""")
def jsonl_block_adapter(spark, sf):
    """Message logs as JSON lines with content blocks, parsed into one typed event per block."""
    rows = _messages(spark, sf)
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    record = F.struct(
        F.when(F.col("role") == "system", "summary").otherwise(F.col("role")).alias("type"),
        F.concat(F.lit("c"), F.col("conv_id")).alias("sessionId"),
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("uuid"),
        F.when(F.col("turn") > 0, F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - 1)).alias("parentUuid"),
        F.struct("role", F.when(F.col("role") == "assistant", F.array(block, block)).otherwise(F.array(block)).alias("content")).alias("message"),
    )
    parsed = parse_lines(rows.select(F.to_json(record).alias("value")), RECORD)
    blocks = parsed.select("record.*", F.posexplode_outer("record.message.content").alias("block", "b"))
    kind = F.when(F.col("type") == "summary", "compact_summary").otherwise(F.concat("message.role", F.lit("_"), "b.type"))
    return blocks.select(F.col("sessionId").alias("session_id"), F.col("uuid").alias("event_id"), F.col("parentUuid").alias("parent_id"), kind.alias("kind"), "block", F.col("b.text").alias("content"))


@query("""SELECT u.conv_id, u.turn AS call_turn, a.turn AS result_turn FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def call_result_pairs(spark, sf):
    """Each request with its result, matched on a shared call id; requests without one stay."""
    rows = _messages(spark, sf)
    calls = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("call_turn"), F.concat_ws("-", "conv_id", F.col("turn") + 1).alias("call_id"))
    results = rows.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.col("turn").alias("result_turn"))
    return calls.join(results, "call_id", "left").drop("call_id")
