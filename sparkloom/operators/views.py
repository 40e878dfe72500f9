"""Views over a conversation event graph: turns, traces, episodes, compaction windows, topics, sessions, cross-session groups.

events(event, session, ordinal, role, text) are the nodes; relations are (source, target) pairs of event names. A view is
one row: its type, its session, its events in order of their names, an id that a rebuild gives again, and how complete it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import identity, tokens
from sparkloom.operators import graph

GENERATION, BUILDER = "g1", "1"
# The dimensions of fidelity, in the order of their levels in a profile.
FIDELITY = ("source_availability", "structure_completeness", "ordering_confidence", "relation_completeness", "content_availability", "compaction_visibility", "native_id_stability")


def conversation_graph(conversations: DataFrame) -> DataFrame:
    """The events of conversations(conv_id, turn, role, text), with the number of the user turn they belong to."""
    order = Window.partitionBy("session").orderBy("ordinal")
    rows = conversations.select(F.concat_ws(":", F.lit("e"), F.col("conv_id"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("event"),
        F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), "role", "text")
    return rows.withColumn("turn_no", F.sum((F.col("role") == "user").cast("int")).over(order))


def assemble(members: DataFrame, kind: str, relation_ok: Column | None = None, native_ok: Column | None = None, visible: Column | None = None) -> DataFrame:
    """Views from members(view, session, event, ordinal, text): one per view key; of equal event sets one stays.

    The flags are aggregates over a view's rows that say whether its relations, native ids and compactions are known."""
    yes = F.lit(True)
    has_text = F.min(F.coalesce(F.col("text") != "", F.lit(False)))
    levels = (F.count("event") > 0, has_text, F.count("ordinal") == F.count("*"), has_text & (yes if relation_ok is None else relation_ok), has_text,
        yes if visible is None else visible, yes if native_ok is None else native_ok)
    profile = F.concat(*[F.when(level, "C").otherwise("P") for level in levels]).alias("fidelity")
    found = members.groupBy("view", "session").agg(F.array_sort(F.collect_set("event")).alias("members"), profile)
    view_id = identity.view_id(F.lit(kind), F.lit(GENERATION), F.lit(BUILDER), F.col("members"))
    return found.select(F.lit(kind).alias("view_type"), view_id.alias("view_id"), "session", "members", "fidelity").dropDuplicates(["view_id"])


def turn_views(events: DataFrame, least_chars: int = 0) -> DataFrame:
    """One view per user turn, of at least so many characters; what precedes the first user message is in none."""
    keyed = events.where("turn_no > 0").withColumn("view", F.concat_ws("/", "session", "turn_no"))
    long_enough = keyed.groupBy("view").agg(F.sum(F.char_length("text")).alias("n")).where(F.col("n") >= least_chars)
    return assemble(keyed.join(long_enough, "view", "left_semi"), "turn")


def replies(events: DataFrame) -> DataFrame:
    """(session, source, target): an event and the next one of the other role that takes up a word of it."""
    order = Window.partitionBy("session").orderBy("ordinal")
    after = events.select("session", "event", "role", tokens.retrieval_tokens(F.col("text")).alias("t"), *[F.lead(c).over(order).alias(f"next_{c}") for c in ("event", "role", "text")])
    taken_up = F.arrays_overlap("t", tokens.retrieval_tokens(F.col("next_text")))
    return after.where((F.col("role") != F.col("next_role")) & taken_up).select("session", F.col("event").alias("source"), F.col("next_event").alias("target"))


def trace_views(events: DataFrame) -> DataFrame:
    """Per assistant message: itself, the events it is related to, and those of its native turn and role."""
    anchors = events.where("role = 'assistant'").select(F.col("event").alias("view"), "session", "turn_no")
    native = anchors.join(events.where("role = 'assistant'").select("session", "turn_no", "event", "ordinal", "text"), ["session", "turn_no"]).select("view", "session", "event", "ordinal", "text")
    related = replies(events).select(F.col("target").alias("view"), F.col("source").alias("event"))
    by_relation = related.join(anchors.select("view"), "view").join(events.select("event", "session", "ordinal", "text"), "event").select("view", "session", "event", "ordinal", "text")
    return assemble(native.unionByName(by_relation), "native_trace")


def episode_views(events: DataFrame) -> DataFrame:
    """Components of related events within a session; a session without relations is one view, which says so."""
    links = replies(events)
    parts = graph.components(links.select(F.col("source").alias("a"), F.col("target").alias("b")))
    linked = links.select("session").distinct().withColumn("linked", F.lit(True))
    rows = events.join(parts.withColumnRenamed("id", "event"), "event", "left").join(linked, "session", "left")
    view = F.when(F.col("linked"), F.coalesce("component", "event")).otherwise(F.concat(F.lit("session/"), F.col("session").cast("string")))
    return assemble(rows.withColumn("view", view), "episode", relation_ok=F.max(F.coalesce("linked", F.lit(False))))


def compaction_views(events: DataFrame, relations: DataFrame) -> DataFrame:
    """Per summary the events that relations(summary, kind, event) call compacted or retained, and those called both."""
    named = relations.groupBy("summary").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "compacted", F.col("event")))).alias("compacted"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "retained", F.col("event")))).alias("retained"))
    members = relations.select(F.col("summary").alias("view"), "event").unionByName(relations.select(F.col("summary").alias("view"), F.col("summary").alias("event"))).distinct()
    views = members.join(events.select("event", "session", "ordinal", "text"), "event")
    found = assemble(views, "compaction_window").withColumn("summary", F.array_max("members"))
    return found.join(named, "summary").withColumn("contradictions", F.array_intersect("compacted", "retained"))


def topic_views(events: DataFrame) -> DataFrame:
    """The opening messages of all sessions, by the most telling word of each."""
    opening = events.where("role = 'user' AND turn_no = 1").withColumn("view", F.try_element_at(tokens.query_tokens(F.lower("text"), 1), F.lit(1)))
    return assemble(opening.where("view IS NOT NULL").withColumn("session", F.lit(None).cast("long")), "topic")


def session_views(events: DataFrame, parts: DataFrame) -> DataFrame:
    """Whole sessions, with the ids of the views made of their events."""
    whole = assemble(events.withColumn("view", F.col("session")), "session")
    lineage = parts.groupBy("session").agg(F.array_sort(F.collect_set("view_id")).alias("member_views"))
    return whole.join(lineage, "session", "left").withColumn("member_views", F.coalesce("member_views", F.array().cast("array<string>")))


def cross_session_views(events: DataFrame) -> DataFrame:
    """Sessions that share a sentence of twelve characters and more, also by way of others; each is linked with the first that holds it."""
    sentences = F.filter(F.transform(F.split("text", r"[.\n]"), lambda t: F.trim(t)), lambda t: F.char_length(t) >= 12)
    holders = events.select("session", F.explode(sentences).alias("t")).select("session", F.md5("t").alias("h")).distinct()
    first = holders.groupBy("h").agg(F.min("session").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = graph.components(holders.join(first, "h").select(F.col("session").alias("a"), F.col("first").alias("b")))
    rows = events.join(groups.withColumnRenamed("id", "session"), "session").withColumn("view", F.col("component").cast("string"))
    return assemble(rows.withColumn("session", F.lit(None).cast("long")), "cross_session")
