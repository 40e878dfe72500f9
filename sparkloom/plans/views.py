"""Views over conversations as an event graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import tokens
from sparkloom.operators import views
from sparkloom.registry import query
from sparkloom.sources.shared import materialize
from sparkloom.sources.tables import table

GENERIC = ", ".join(f"'{w}'" for w in tokens.GENERIC if w.isascii())
GRAPH = f"""WITH RECURSIVE ev AS (SELECT 'e:' || conv_id || ':' || lpad(turn::VARCHAR, 6, '0') AS event, conv_id AS session, turn AS ordinal, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations),
tk AS (SELECT *, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), lambda w: w NOT IN ({GENERIC})) AS t FROM ev),
nx AS (SELECT session, event, role, t, lead(event) OVER o AS ne, lead(role) OVER o AS nr, lead(t) OVER o AS nt FROM tk WINDOW o AS (PARTITION BY session ORDER BY ordinal)),
rp AS (SELECT session, event AS source, ne AS target FROM nx WHERE role <> nr AND list_has_any(t, nt)),
"""
ASSEMBLED = """SELECT view_type, 'view:' || sha256(view_type || '|g1|1|' || array_to_string(members, '|')) AS view_id, session, members, 'C' || p || 'C' || CASE WHEN rel THEN p ELSE 'P' END || p || 'CC' AS fidelity
FROM (SELECT view_type, view, session, list_sort(list_distinct(list(event))) AS members, CASE WHEN bool_and(coalesce(text <> '', false)) THEN 'C' ELSE 'P' END AS p, bool_or(rel) AS rel FROM mem GROUP BY view_type, view, session)
QUALIFY row_number() OVER (PARTITION BY view_type, members ORDER BY view) = 1"""
TURN = "SELECT 'turn' AS view_type, session || '/' || turn_no AS view, session, event, text, true AS rel FROM ev WHERE turn_no > 0 QUALIFY sum(length(text)) OVER (PARTITION BY session, turn_no) >= 40"
TRACE = """SELECT 'native_trace' AS view_type, a.event AS view, a.session, b.event, b.text, true AS rel FROM ev a JOIN ev b ON a.session = b.session AND a.turn_no = b.turn_no AND b.role = 'assistant' WHERE a.role = 'assistant'
UNION ALL SELECT 'native_trace', rp.target, ev.session, rp.source, ev.text, true FROM rp JOIN ev ON ev.event = rp.source JOIN ev x ON x.event = rp.target AND x.role = 'assistant'"""
EPISODE_PARTS = "ed AS (SELECT source AS a, target AS b FROM rp UNION SELECT target, source FROM rp), re AS (SELECT event AS id, event AS o FROM ev UNION SELECT re.id, ed.b FROM re JOIN ed ON re.o = ed.a), co AS (SELECT id, min(o) AS c FROM re GROUP BY id), "
EPISODE = "SELECT 'episode' AS view_type, CASE WHEN ev.session IN (SELECT session FROM rp) THEN co.c ELSE 'session/' || ev.session END AS view, ev.session, event, text, ev.session IN (SELECT session FROM rp) AS rel FROM ev JOIN co ON co.id = ev.event"
LAST = "la AS (SELECT session, max(ordinal) AS last FROM ev GROUP BY session HAVING count(*) >= 4), cr AS (SELECT s.event AS summary, k.kind, e.event FROM la JOIN ev s ON s.session = la.session AND s.ordinal = la.last JOIN ev e ON e.session = la.session AND e.ordinal < la.last JOIN (VALUES ('compacted'), ('retained')) k(kind) ON (k.kind = 'compacted' AND e.ordinal <= la.last - 2) OR (k.kind = 'retained' AND e.ordinal >= la.last - 2)), "
COMPACTION = "SELECT 'compaction_window' AS view_type, x.summary AS view, ev.session, x.event, ev.text, true AS rel FROM (SELECT summary, event FROM cr UNION SELECT summary, summary FROM cr) x JOIN ev ON ev.event = x.event"
TOPIC = "SELECT 'topic' AS view_type, w AS view, NULL::BIGINT AS session, event, text, true AS rel FROM (SELECT event, text, list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_\\-]{3,}')), lambda x: struct_pack(n := -length(x), t := x))), lambda x: x.t)[1] AS w FROM ev WHERE role = 'user' AND turn_no = 1) WHERE w IS NOT NULL"
SESSION = "SELECT 'session' AS view_type, session::VARCHAR AS view, session, event, text, true AS rel FROM ev"
CROSS_PARTS = "ho AS (SELECT DISTINCT session, md5(trim(t)) AS h FROM (SELECT session, unnest(regexp_split_to_array(text, '[.\\n]')) AS t FROM ev) WHERE length(trim(t)) >= 12), xe AS (SELECT x.session AS a, y.session AS b FROM ho x JOIN ho y ON x.h = y.h AND x.session <> y.session), xr AS (SELECT a AS id, a AS o FROM xe UNION SELECT xr.id, xe.b FROM xr JOIN xe ON xr.o = xe.a), xc AS (SELECT id, min(o) AS c FROM xr GROUP BY id), "
CROSS = "SELECT 'cross_session' AS view_type, xc.c::VARCHAR AS view, NULL::BIGINT AS session, event, text, true AS rel FROM ev JOIN xc ON xc.id = ev.session"


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    return views.conversation_graph(table(spark, sf, "conversations"))


def _turns(events: DataFrame) -> DataFrame:
    return views.turn_views(events, least_chars=40)


def _compactions(events: DataFrame) -> DataFrame:
    """The last message of a session of four and more stands for a summary: of what lies two and more before it, and it keeps the last two."""
    back = F.max("ordinal").over(Window.partitionBy("session")) - F.col("ordinal")
    rows = events.withColumn("back", back).withColumn("n", F.count("*").over(Window.partitionBy("session"))).where("n >= 4")
    last = rows.where("back = 0").select("session", F.col("event").alias("summary"))
    kinds = F.array_compact(F.array(F.when(F.col("back") >= 2, "compacted"), F.when(F.col("back") <= 2, "retained")))
    relations = rows.where("back > 0").select("session", "event", F.explode(kinds).alias("kind")).join(last, "session").select("summary", "kind", "event")
    return views.compaction_views(events, relations)


@query(GRAPH + f"mem AS ({TURN}) {ASSEMBLED}")
def views_turn(spark, sf):
    """User turns of at least 40 characters."""
    return _turns(_graph(spark, sf))


@query(GRAPH + f"mem AS ({TRACE}) {ASSEMBLED}")
def views_trace(spark, sf):
    return views.trace_views(_graph(spark, sf))


@query(GRAPH + EPISODE_PARTS + f"mem AS ({EPISODE}) {ASSEMBLED}")
def views_episode(spark, sf):
    return views.episode_views(_graph(spark, sf))


@query(GRAPH + LAST + f"mem AS ({COMPACTION}), vs AS ({ASSEMBLED}) SELECT vs.*, members[-1] AS summary, (SELECT list_sort(list(event)) FROM cr WHERE kind = 'compacted' AND cr.summary = members[-1]) AS compacted, (SELECT list_sort(list(event)) FROM cr WHERE kind = 'retained' AND cr.summary = members[-1]) AS retained, (SELECT list_sort(list(x.event)) FROM cr x JOIN cr y ON x.summary = y.summary AND x.event = y.event AND x.kind < y.kind WHERE x.summary = members[-1]) AS contradictions FROM vs")
def views_compaction(spark, sf):
    """Compaction windows; an event both compacted and retained is a contradiction."""
    return _compactions(_graph(spark, sf))


@query(GRAPH + f"mem AS ({TOPIC}) {ASSEMBLED}")
def views_topic(spark, sf):
    return views.topic_views(_graph(spark, sf))


@query(GRAPH + f"tm AS ({TURN}), tv AS ({ASSEMBLED.replace('FROM mem', 'FROM tm')}), mem AS ({SESSION}), sv AS ({ASSEMBLED}) SELECT sv.*, coalesce((SELECT list_sort(list(tv.view_id)) FROM tv WHERE tv.session = sv.session), []) AS member_views FROM sv")
def views_session(spark, sf):
    """Sessions with the turn views made of their events."""
    events = _graph(spark, sf)
    return views.session_views(events, _turns(events))


@query(GRAPH + CROSS_PARTS + f"mem AS ({CROSS}) {ASSEMBLED}")
def views_cross_session(spark, sf):
    return views.cross_session_views(_graph(spark, sf))


ALL = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (TURN, TRACE, EPISODE, COMPACTION, TOPIC, SESSION, CROSS))


@query(GRAPH + EPISODE_PARTS + LAST + CROSS_PARTS + f"mem AS ({ALL}), vs AS ({ASSEMBLED}) SELECT view_type, count(*) AS n, sum(len(members))::BIGINT AS events, count(*) FILTER (contains(fidelity, 'P')) AS partial, sha256(string_agg(view_id, '' ORDER BY view_id)) AS digest FROM vs GROUP BY view_type")
def views_all(spark, sf):
    """All views by type: how many, of how many events, how many incomplete, and a digest that a rebuild gives again."""
    events = materialize(_graph(spark, sf))
    turns = _turns(events)
    every = [turns, views.trace_views(events), views.episode_views(events), _compactions(events), views.topic_views(events), views.session_views(events, turns), views.cross_session_views(events)]
    rows = reduce(DataFrame.unionByName, [v.select("view_type", "view_id", "members", "fidelity") for v in every])
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("view_id")), ""), 256)
    return rows.groupBy("view_type").agg(F.count("*").alias("n"), F.sum(F.size("members")).alias("events"), F.count_if(F.contains("fidelity", F.lit("P"))).alias("partial"), digest.alias("digest"))


@query(GRAPH + """w AS (SELECT event, list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_\\-]{3,}')), lambda x: struct_pack(n := -length(x), t := x))), lambda x: x.t)[1:2] AS topics FROM ev)
SELECT 'next' AS kind, event AS src, ne AS dst FROM nx WHERE ne IS NOT NULL UNION ALL SELECT 'has', 's:' || session, event FROM ev UNION ALL SELECT 'used', event, 'r:' || role FROM ev UNION ALL SELECT 'topic', event, 't:' || unnest(topics) FROM w""")
def conversation_graph_edges(spark, sf):
    """The property graph of all conversations: what follows, who speaks, and the two most telling words of each message."""
    events = _graph(spark, sf)
    edge = lambda kind, src, dst: F.struct(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"))
    event = F.col("event")
    named = events.select("event", "session", "role", "text", F.lead("event").over(Window.partitionBy("session").orderBy("ordinal")).alias("after"))
    topics = F.transform(tokens.query_tokens(F.lower("text"), 2), lambda t: edge("topic", event, F.concat(F.lit("t:"), t)))
    fixed = F.array(edge("has", F.concat(F.lit("s:"), F.col("session").cast("string")), event), edge("used", event, F.concat(F.lit("r:"), "role")))
    following = F.when(F.col("after").isNotNull(), F.array(edge("next", event, F.col("after")))).otherwise(F.array().cast("array<struct<kind:string,src:string,dst:string>>"))
    return named.select(F.explode(F.concat(fixed, following, topics)).alias("e")).select("e.*")


@query(GRAPH + """w AS (SELECT event, list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_\\-]{3,}')), lambda x: struct_pack(n := -length(x), t := x))), lambda x: x.t)[1:2] AS topics FROM ev),
n AS (SELECT 'session' AS kind, 's:' || session AS node FROM ev UNION SELECT 'event', event FROM ev UNION SELECT 'role', 'r:' || role FROM ev UNION SELECT 'topic', 't:' || unnest(topics) FROM w) SELECT kind, count(*) AS n FROM n GROUP BY kind""")
def conversation_graph_nodes(spark, sf):
    """The nodes of the property graph by kind."""
    events = _graph(spark, sf)
    node = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("node"))
    topics = F.transform(tokens.query_tokens(F.lower("text"), 2), lambda t: node("topic", F.concat(F.lit("t:"), t)))
    fixed = F.array(node("session", F.concat(F.lit("s:"), F.col("session").cast("string"))), node("event", F.col("event")), node("role", F.concat(F.lit("r:"), "role")))
    return events.select(F.explode(F.concat(fixed, topics)).alias("n")).select("n.*").distinct().groupBy("kind").agg(F.count("*").alias("n"))
