"""Conversation logs of several families as one table of typed events and one of relations between them.

A family is a declaration: which record types mean which kind of event, and where its ids, texts and calls are found.
Families whose records come in two shapes, flat or nested under a payload, name the paths of both. Every line is parsed
once, into a variant, and all families are read from it in one pass, so a scan of many files of mixed families is one job.
A session can also be a folder of files of different kinds, which read_directories() brings together.

Defined cases: a line that is no JSON, a record of an unknown type, and an artifact without any known record give no
events, and rejects() tells how many there were; a record without a session belongs to the first one of its artifact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from sparkloom.functions import identity
from sparkloom.sources.shared import materialize


@dataclass(frozen=True)
class Family:
    """Paths are tried in order; ``signs`` are record types that only this family has.

    kinds are keyed by a record's type, or by type/inner type (and /part type), of which the longest that fits counts.
    A kind of "message" is told by the role, "context" too where a role is given."""

    signs: tuple[str, ...]
    kinds: dict[str, str]
    session: tuple[str, ...] = ("session_id",)
    native: tuple[str, ...] = ("message_id",)
    turn: tuple[str, ...] = ("turn_id",)
    text: tuple[str, ...] = ("content",)
    call: tuple[str, ...] = ("call_id",)
    at: tuple[str, ...] = ("timestamp",)
    parent: tuple[str, ...] = ()
    blocks: tuple[str, ...] = ()
    inner: tuple[str, ...] = ()
    usage: tuple[str, ...] = ()


def _each(names: tuple[str, ...], kind: str, under: str = "") -> dict[str, str]:
    return {under + n: kind for n in names}


# The record types and fields of each family, as their logs write them.
FAMILIES = {
    "codex": Family(
        ("session_meta", "turn_context", "response_item", "context_compacted", "event_msg"),
        {"session_meta": "session_start", "turn_context": "user_message", "response_item": "message", "function_call": "tool_call",
            "function_call_output": "tool_result", "context_compacted": "compaction_summary", "world_state": "file_context", "event_msg": "unknown"}
        | _each(("function_call", "custom_tool_call", "tool_search_call", "web_search_call"), "tool_call", "response_item/")
        | _each(("function_call_output", "custom_tool_call_output", "tool_search_output"), "tool_result", "response_item/")
        | {"response_item/reasoning": "reasoning", "response_item/agent_message": "assistant_message", "event_msg/agent_message": "assistant_message",
            "event_msg/user_message": "user_message", "event_msg/context_compacted": "compaction_summary", "event_msg/token_count": "usage", "event_msg/thread_settings_applied": "file_context"}
        | _each(("agent_reasoning", "reasoning"), "reasoning", "event_msg/")
        | _each(("task_started", "task_complete", "item_completed"), "loop", "event_msg/")
        | _each(("exec_command_end", "web_search_end", "patch_apply_end", "mcp_tool_call_end"), "tool_result", "event_msg/")
        | _each(("turn_aborted", "turn_started", "agent_turn_started"), "turn_boundary", "event_msg/")
        | _each(("collab_agent_spawn_end", "collab_close_end", "sub_agent_activity", "collab_agent_interaction_end", "collab_waiting_end"), "subagent", "event_msg/"),
        session=("session_id", "payload.session_id"), native=("item_id", "payload.item_id", "payload.id"), turn=("turn_id", "payload.turn_id"),
            call=("call_id", "payload.call_id"), at=("timestamp", "payload.timestamp"), inner=("payload.type",),
        text=("prompt", "payload.content", "content", "payload.message", "payload.text", "payload.arguments", "payload.input", "arguments",
            "payload.action.query", "payload.output", "output", "payload.aggregated_output", "payload.stdout", "payload.last_agent_message",
            "payload.item.text", "payload.summary", "summary", "payload.new_agent_nickname", "payload.stderr", "payload.reason", "payload.error"),
        usage=("payload.usage", "usage", "payload.info.last_token_usage", "payload.info.total_token_usage", "payload.info"),
    ),
    "copilot": Family(
        ("tool_execution_start", "tool_execution_complete", "turn_end"),
        {"turn_start": "turn_start", "turn_end": "turn_end", "user_message": "user_message", "assistant_message": "assistant_message",
            "tool_execution_start": "tool_call", "tool_execution_complete": "tool_result"},
        text=("content", "name"), call=("tool_id",),
    ),
    "pi": Family(
        ("conversation", "compaction"),
        {"conversation": "session_start", "user_message": "user_message", "assistant_message": "assistant_message", "compaction": "compaction_summary"},
        session=("conversation_id", "id"), text=("content", "summary", "title"),
    ),
    "kimi": Family(
        ("loop_iteration", "context_append", "user_prompt", "task_complete", "context.append_loop_event", "turn.prompt", "tool.call.started", "turn.step.started"),
        {"turn_start": "turn_start", "user_prompt": "user_message", "assistant_message": "assistant_message", "loop_iteration": "loop",
            "context_append": "context", "context.append_message": "context", "task_complete": "turn_end", "metadata": "session_start",
            "turn.prompt": "user_message", "usage.record": "usage", "context.append_loop_event": "unknown", "context.spliced": "context", "error": "unknown"}
        | _each(("step.begin", "step.end"), "loop", "context.append_loop_event/")
        | {"context.append_loop_event/tool.call": "tool_call", "context.append_loop_event/tool.result": "tool_result",
            "context.append_loop_event/content.part": "unknown", "context.append_loop_event/content.part/text": "assistant_message",
            "context.append_loop_event/content.part/think": "reasoning", "tool.call.started": "tool_call", "tool.result": "tool_result"}
        | _each(("task.started", "task.terminated", "task.notified", "background.task.started", "background.task.terminated", "goal.create", "goal.update", "goal.updated", "goal.clear"), "loop")
        | _each(("turn.cancel", "turn.steer", "turn.started", "turn.ended", "turn.step.started", "turn.step.completed", "turn.step.interrupted", "prompt.completed", "prompt.aborted"), "turn_boundary")
        | _each(("full_compaction.begin", "context.apply_compaction", "full_compaction.complete", "compaction.started", "compaction.completed", "compaction.blocked"), "compaction_summary")
        | _each(("subagent.spawned", "subagent.started", "subagent.completed", "subagent.failed"), "subagent")
        | _each(("agent.created", "event.session.created", "event.session.work_changed", "session.meta.updated", "skill.activated", "journal_header"), "session_start"),
        session=("session_id", "envelope.session_id"), native=("message_id", "event.uuid"), turn=("task_id", "event.turnId", "envelope.payload.turnId"),
            call=("event.toolCallId", "envelope.payload.toolCallId"), at=("time", "timestamp", "created_at", "envelope.timestamp"), inner=("event.type", "event.part.type"),
        text=("content", "message.content", "event.content", "input", "event.part.text", "event.part.think", "event.args", "arguments", "event.result.text",
            "event.result.output", "event.result", "output", "summary", "contextSummary", "envelope.payload.output", "envelope.payload.name"),
        usage=("usage", "event.usage"),
    ),
    "workbuddy": Family(
        ("function_call_result", "reasoning", "message"),
        {"message": "message", "reasoning": "reasoning", "function_call": "tool_call", "function_call_result": "tool_result", "file-history-snapshot": "file_context"},
        text=("content", "arguments", "result"),
    ),
    "grok": Family(
        ("chat_message", "chat_compaction"),
        {"chat_message": "message", "chat_compaction": "compaction_summary"},
        session=("chat_id",), native=("id",), text=("text", "summary"),
    ),
    "blocks": Family(
        ("user", "assistant", "system"),
        {"user": "user_message", "assistant": "assistant_message", "system": "system"},
        session=("sessionId", "session_id"), native=("uuid",), parent=("parentUuid",), blocks=("message.content", "content"),
    ),
}
# What a message is by its role, whose words an event is, block types that hold text, and the names of token counts.
ROLES = {"user": "user_message", "assistant": "assistant_message", "model": "assistant_message", "developer": "developer_message"}
SPEAKERS = {"user_message": "user", "assistant_message": "assistant", "reasoning": "assistant", "tool_call": "assistant"}
TEXT_BLOCKS = ("text", "input_text", "output_text", "summary_text")
TOKENS = {
    "input_tokens": ("input_tokens", "inputTokens", "prompt_tokens"), "output_tokens": ("output_tokens", "outputTokens", "completion_tokens"),
    "cache_read": ("cache_read_input_tokens", "cached_input_tokens", "cache_read", "cacheRead"),
        "cache_write": ("cache_creation_input_tokens", "cache_write_input_tokens", "cache_write", "cacheWrite"),
}
EVENT = "family string, artifact string, session string, ordinal int, event string, native string, parent string, turn string, kind string, role string, call string, text string, at string, kept string, side boolean"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, place, value): the lines of files in their order, blank ones left out."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.select(F.col("_metadata.file_path").alias("artifact"), place.alias("place"), "value")


def _get(path: str, kind: str = "string", of: Column | str = "v") -> Column:
    """What a variant holds at a path; an empty text is nothing."""
    found = F.try_variant_get(F.col(of) if isinstance(of, str) else of, f"$.{path}" if path else "$", kind)
    return F.nullif(found, F.lit("")) if kind == "string" else found


class Reader:
    """Reads all that a family's records hold by one cast of the variant to a struct, of which fields are then taken.

    What may be a text or a list stays a variant, and so does what has further paths below it."""

    def __init__(self, name: str, family: Family):
        self.family, self.column = family, f"of_{name}"
        texts = {*family.text, *family.blocks, *family.usage}
        plain = {p for paths in (family.session, family.native, family.turn, family.call, family.at, family.parent, family.inner) for p in paths}
        leaves = dict.fromkeys(plain, "string") | dict.fromkeys(texts, "variant")
        # A path that goes on below another one is read from the variant that the other one is.
        self.leaves = {p: kind for p, kind in leaves.items() if not any(p.startswith(f"{q}.") for q in texts)}
        tree: dict = {}
        for path, kind in self.leaves.items():
            *above, last = path.split(".")
            node = tree
            for part in above:
                node = node.setdefault(part, {})
            node[last] = kind
        self.record = F.try_variant_get(F.col("v"), "$", self._struct(tree)).alias(self.column)

    def _struct(self, node: dict) -> str:
        return "struct<" + ",".join(f"{k}:{self._struct(v) if isinstance(v, dict) else v}" for k, v in node.items()) + ">"

    def leaf(self, path: str, kind: str) -> Column:
        if path in self.leaves:
            found = F.col(f"{self.column}.{path}")
            return found if self.leaves[path] == kind else _get("", kind, found)
        base = max((q for q in self.leaves if path.startswith(f"{q}.")), key=len)
        return _get(path[len(base) + 1 :], kind, F.col(f"{self.column}.{base}"))

    def text(self, paths: tuple[str, ...]) -> Column:
        """The first text at the paths that isn't empty."""
        return F.coalesce(*[F.nullif(self.leaf(p, "string"), F.lit("")) for p in paths]) if paths else F.lit(None).cast("string")

    def variants(self, paths: tuple[str, ...]) -> Column:
        """Those that are there and no null, in order. A list keeps the code of a record short, however many paths it has."""
        found = F.array(*[self.leaf(p, "variant") for p in paths])
        return F.filter(found, lambda f: f.isNotNull() & ~F.is_variant_null(f))

    def usage(self) -> Column:
        """Token counts as text, of the first path that has any."""
        if not self.family.usage:
            return F.lit(None).cast("string")
        counts = "struct<" + ",".join(f"{n}:bigint" for names in TOKENS.values() for n in names) + ">"

        def said(found: Column) -> Column:
            one = F.try_variant_get(found, "$", counts)
            return F.concat_ws(" ", *[F.concat(F.lit(f"{label}="), F.coalesce(*[one[n] for n in names]).cast("string")) for label, names in TOKENS.items()])

        return F.get(F.filter(F.transform(self.variants(self.family.usage), said), lambda t: t != ""), 0)


def _said(found: Column) -> Column:
    """The text of a variant: its own, or that of a list of blocks."""
    blocks = F.filter(F.try_variant_get(found, "$", "array<struct<type:string,text:string>>"), lambda b: b["type"].isin(*TEXT_BLOCKS))
    joined = F.when(F.size(F.coalesce(blocks, F.array())) > 0, F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), " "))
    return F.coalesce(joined, F.try_variant_get(found, "$", "string"))


def _type() -> Column:
    """A record's type; of journal entries that of the envelope."""
    return F.coalesce(_get("type"), F.when(_get("kind") == "event", _get("envelope.type")).otherwise(_get("kind")))


def _family(whole: WindowSpec) -> Column:
    """The family with most of an artifact's records among its signs (ties: the first in order); none without any."""
    counts = [F.count_if(F.col("type").isin(*f.signs)).over(whole) for f in FAMILIES.values()]
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("family")) for i, (name, n) in enumerate(zip(FAMILIES, counts, strict=True))]))
    return F.when(best["n"] > 0, best["family"])


def parsed(lines: DataFrame) -> DataFrame:
    """lines(artifact, place, value) with each record as a variant, its type, and the family of its artifact."""
    rows = lines.select("artifact", "place", F.try_parse_json("value").alias("v")).withColumn("sound", F.col("v").isNotNull())
    return rows.withColumn("type", _type()).withColumn("family", _family(Window.partitionBy("artifact")))


def detect(lines: DataFrame) -> DataFrame:
    """(artifact, family) of the artifacts that have a family."""
    return parsed(lines).where("family IS NOT NULL").select("artifact", "family").distinct()


def _kind(readers: dict[str, Reader]) -> Column:
    known = F.create_map(*[F.lit(x) for name, f in FAMILIES.items() for t, kind in f.kinds.items() for x in (f"{name}:{t}", kind)])
    inner, part = (F.coalesce(*[r.text(r.family.inner[n : n + 1]) for r in readers.values() if len(r.family.inner) > n]) for n in (0, 1))
    head = F.concat(F.col("family"), F.lit(":"), F.col("type"))
    keys = [F.concat(head, F.lit("/"), inner, F.lit("/"), part), F.concat(head, F.lit("/"), inner), head]
    kind = F.coalesce(*[F.try_element_at(known, k) for k in keys])
    by_role = F.try_element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.col("speaker"))
    message = F.when(by_role.isNotNull(), by_role).when(inner.isNotNull(), "unknown").otherwise("assistant_message")
    return F.when(F.col("compact") & kind.isNotNull(), "compaction_summary").when(kind == "message", message).when(kind == "context", F.coalesce(by_role, kind)).otherwise(kind)


def _records(lines: DataFrame) -> tuple[DataFrame, dict[str, Reader]]:
    """The records of artifacts that have a family, read in that family's way, with their kind."""
    readers = {name: Reader(name, f) for name, f in FAMILIES.items()}
    role = F.coalesce(_get("role"), _get("payload.role"), _get("message.role"))
    flag = lambda p: F.coalesce(_get(p, "boolean"), F.lit(False))
    rows = parsed(lines).select("*", role.alias("speaker"), flag("isCompactSummary").alias("compact"), flag("isSidechain").alias("side"),
        _get("firstKeptEntryId").alias("kept"), _get("payload.id").alias("inner_id"))
    rows = rows.select("*", *[F.when(F.col("family") == n, r.record).alias(r.column) for n, r in readers.items()]).drop("v")
    return rows.withColumn("kind", _kind(readers)), readers


def _block_events(record: Column, content: Column) -> Column:
    """One entry per content block; a record without blocks is one entry of its own."""
    block = "array<struct<type string, text string, thinking string, id string, name string, tool_use_id string, content string>>"
    listed = F.from_json(content, block)
    kinds = F.create_map(*[F.lit(x) for pair in (("thinking", "reasoning"), ("tool_use", "tool_call"), ("tool_result", "tool_result")) for x in pair])
    entry = lambda b, i: F.struct(i.alias("i"), F.coalesce(F.try_element_at(kinds, b["type"]), record).alias("kind"),
        F.coalesce(b["text"], b["thinking"], b["content"], b["name"], F.lit("")).alias("text"), F.coalesce(b["tool_use_id"], b["id"]).alias("call"))
    none = F.array(F.struct(F.lit(0).alias("i"), record.alias("kind"), F.coalesce(content, F.lit("")).alias("text"), F.lit(None).cast("string").alias("call")))
    return F.when(F.size(F.coalesce(listed, F.array())) > 0, F.transform(listed, entry)).otherwise(none)


def _entries() -> Column:
    """The events of a record: its blocks, or itself and what it says about tokens."""
    none = F.lit(None).cast("string")
    entry = lambda i, kind, text, call: F.struct(F.lit(i).alias("i"), kind.alias("kind"), F.coalesce(text, F.lit("")).alias("text"), call.alias("call"))
    kind = F.when((F.col("kind") == "usage") & F.col("usage").isNull(), "unknown").when((F.col("type") == "turn_context") & F.col("text").isNull(), "turn_boundary").otherwise(F.col("kind"))
    own = F.array(entry(0, kind, F.when(kind == "usage", F.col("usage")).otherwise(F.col("text")), F.col("call")))
    also = F.when(F.col("usage").isNotNull() & (F.col("kind") != "usage"), F.concat(own, F.array(entry(1, F.lit("usage"), F.col("usage"), none)))).otherwise(own)
    return F.when(F.col("family") == "blocks", _block_events(F.col("kind"), F.col("blocks"))).otherwise(also)


def adapt_all(lines: DataFrame) -> DataFrame:
    """The events of lines(artifact, place, value) of artifacts of any family; records of unknown types are left out."""
    rows, readers = _records(lines)
    rows = rows.where("family IS NOT NULL AND kind IS NOT NULL")
    field = lambda name: F.coalesce(*[r.text(getattr(r.family, name)) for r in readers.values()])
    own = F.coalesce(field("session"), F.when((F.col("family") == "codex") & (F.col("kind") == "session_start"), F.col("inner_id")))
    said = F.coalesce(*[F.when(F.col("family") == n, F.get(r.variants(r.family.text), 0)) for n, r in readers.items()])
    rows = rows.select(
        "family", "artifact", "place", "type", "kind", own.alias("session"), *[field(n).alias(n) for n in ("native", "turn", "parent", "call", "blocks")], said.alias("said"),
        identity.utc_time(field("at")).alias("at"), F.coalesce(*[r.usage() for r in readers.values()]).alias("usage"), "kept", "side",
    )
    first = F.first("session", ignorenulls=True).over(Window.partitionBy("artifact").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("text", F.nullif(_said(F.col("said")), F.lit(""))).drop("said")
    rows = rows.withColumn("session", F.coalesce("session", first)).withColumn("e", F.explode(_entries()))
    rows = rows.select("family", "artifact", "place", "session", "native", "turn", "parent", F.col("e.call").alias("call"), F.col("e.kind").alias("kind"),
        F.col("e.text").alias("text"), "at", "kept", "side", F.col("e.i").alias("i"))
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("artifact", "session").orderBy("place", "i")))
    return rows.select("family", "artifact", "session", "ordinal", _event(rows), "native", "parent", "turn", "kind", _speaker(), "call", "text", "at", "kept", "side")


def _event(rows: DataFrame) -> Column:
    """An event's id: by its native id where it has one, else by its place."""
    locator = F.col("ordinal").cast("string")
    native = F.concat_ws("#", F.col("native"), F.when(F.col("i") > 0, F.col("i").cast("string")))
    made = lambda n, at: identity.event_id(F.col("family"), F.lit("1"), F.col("artifact"), n, F.col("kind"), F.col("session"), at)
    return F.when(F.col("native").isNull(), made(F.lit(None).cast("string"), locator)).otherwise(made(native, F.lit(None).cast("string"))).alias("event")


def _speaker() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair]), F.col("kind")), F.lit("system")).alias("role")


def rejects(lines: DataFrame) -> DataFrame:
    """(artifact, reason, n) of the lines that give no event, or one without a session."""
    reason = F.when(~F.col("sound"), "no JSON").when(F.col("family").isNull(), "no family").when(F.col("kind").isNull(), "unknown type")
    lost = _records(lines)[0].select("artifact", reason.alias("reason")).where("reason IS NOT NULL").groupBy("artifact", "reason").agg(F.count("*").alias("n"))
    homeless = adapt_all(lines).where("session IS NULL").groupBy("artifact").agg(F.count("*").alias("n"))
    return lost.unionByName(homeless.select("artifact", F.lit("no session").alias("reason"), "n"))


# The files of a session kept as a folder, in the order their events have.
DIRECTORY = ("summary.md", "summary.json", "chat_history.jsonl", "compaction.md", "checkpoint.json", "recap.md", "subagents.json")


def read_directories(spark: SparkSession, path: str) -> DataFrame:
    """Events of sessions that are folders: a summary, the chat, compactions and helpers, each a file of its own.

    Files are read whole, as Spark reads them; what belongs to one folder meets by its name."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    place = F.col("_metadata.file_path")
    return directory_events(files.select(F.regexp_extract(place, r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(place, r"[^/]*$", 0).alias("name"), "value"))


def directory_events(files: DataFrame) -> DataFrame:
    """The same of files(folder, name, value). Messages without a role are of kind unknown."""
    rank = F.array_position(F.array(*[F.lit(n) for n in DIRECTORY]), F.col("name"))
    null, doc = F.lit(None).cast("string"), lambda p: F.nullif(F.get_json_object("value", f"$.{p}"), F.lit(""))
    tail, whole = F.regexp_extract("folder", r"[^/]*$", 0), Window.partitionBy("folder")
    of = lambda name, c: F.max(F.when(F.col("name") == name, c)).over(whole)
    session = F.coalesce(of("summary.json", F.coalesce(doc("info.id"), tail)), of("summary.md", F.regexp_extract("value", r"^[^\n]*", 0)), tail)
    rows = files.withColumn("rank", rank).where("rank > 0").withColumn("session", session)
    key = ["folder", "name", "session", "rank"]

    def entry(n: Column, native: Column, kind: Column | str, text: Column, at: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), native.alias("native"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.coalesce(text, F.lit("")).alias("text"), at.alias("at"))

    one = (
        F.when(F.col("name") == "summary.json", entry(F.lit(0), F.col("session"), "session_start", null, doc("created_at")))
        .when(F.col("name") == "summary.md", entry(F.lit(0), F.lit("summary"), "session_start", F.col("value"), null))
        .otherwise(entry(F.lit(0), F.col("name"), "compaction_summary", F.col("value"), null))
    )
    documents = rows.where(~F.col("name").isin("chat_history.jsonl", "subagents.json")).select(*key, one.alias("e"))
    told = entry(F.lit(1), F.concat("session", F.lit(":summary")), "compaction_summary", doc("session_summary"), doc("updated_at"))
    summaries = rows.where((F.col("name") == "summary.json") & doc("session_summary").isNotNull()).select(*key, told.alias("e"))
    helper = "array<struct<id string, name string, task string, created_at string>>"
    listed = rows.where("name = 'subagents.json'").select(*key, F.posexplode(F.from_json(F.coalesce(doc("subagents"), "value"), helper)).alias("i", "h"))
    helpers = listed.select(*key, entry(F.col("i"), F.coalesce("h.id", F.concat(F.lit("sub-"), F.col("i").cast("string"))), "subagent",
        F.coalesce("h.name", "h.task"), F.col("h.created_at")).alias("e"))
    lines = rows.where("name = 'chat_history.jsonl'").select(*key, F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.try_parse_json(x).isNotNull())).alias("i", "line"))
    lines = lines.withColumn("v", F.try_parse_json("line"))
    role = F.create_map(*[F.lit(x) for pair in (("user", "user_message"), ("assistant", "assistant_message"), ("model", "assistant_message")) for x in pair])
    kind, native = F.coalesce(F.try_element_at(role, _get("role")), F.lit("unknown")), F.coalesce(_get("id"), F.concat(F.lit("row-"), F.col("i").cast("string")))
    chat = lines.select(*key, entry(2 * F.col("i"), native, kind, _get("content"), _get("timestamp")).alias("e"))
    count = lambda names: F.coalesce(*[_get(p, "long") for n in names for p in (n, f"usage.{n}")])
    tokens = F.nullif(F.concat_ws(" ", *[F.concat(F.lit(f"{label}="), count(names).cast("string")) for label, names in TOKENS.items()]), F.lit(""))
    used = lines.where((kind != "unknown") & tokens.isNotNull()).select(*key, entry(2 * F.col("i") + 1, F.concat(native, F.lit(":usage")), "usage", tokens, _get("timestamp")).alias("e"))
    found = documents.unionByName(summaries).unionByName(helpers).unionByName(chat).unionByName(used)
    found = found.select(F.lit("grok").alias("family"), F.concat_ws("/", "folder", "name").alias("artifact"), *key, "e.n", "e.native", "e.kind", "e.text",
        identity.utc_time(F.col("e.at")).alias("at"), F.lit(0).alias("i"))
    found = found.withColumn("ordinal", F.row_number().over(whole.orderBy("rank", "n")))
    return found.select("family", "artifact", "session", "ordinal", _event(found), "native", null.alias("parent"), null.alias("turn"), "kind", _speaker(),
        null.alias("call"), "text", "at", null.alias("kept"), F.lit(False).alias("side"), "folder", "name")


def directory_relations(events: DataFrame) -> DataFrame:
    """(kind, source, target): each compaction file with the last event before it that is none, each helper with its session."""
    before = Window.partitionBy("folder").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.when(~F.col("kind").isin("compaction_summary"), F.col("event"))
    rows = events.withColumn("prior", F.last(plain, ignorenulls=True).over(before)).withColumn("home", F.first(F.when(F.col("kind") == "session_start", F.col("event")), ignorenulls=True).over(before))
    compacted = rows.where("kind = 'compaction_summary' AND name <> 'summary.json' AND prior IS NOT NULL").select(F.lit("compacted_range").alias("kind"),
        F.col("prior").alias("source"), F.col("event").alias("target"))
    return compacted.unionByName(rows.where("kind = 'subagent' AND home IS NOT NULL").select(F.lit("source_session_crosswalk").alias("kind"),
        F.col("event").alias("source"), F.col("home").alias("target")))


def read_documents(documents: DataFrame) -> DataFrame:
    """Events of documents(artifact, value) that are one JSON object each with an ordered list of messages."""
    parsed = documents.select("artifact", F.get_json_object("value", "$.session_id").alias("session"),
        F.from_json(F.get_json_object("value", "$.messages"), "array<struct<role string, content string, timestamp string>>").alias("m"))
    rows = parsed.select("artifact", "session", F.posexplode("m").alias("i", "m"))
    kind = F.when(F.col("m.role") == "user", "user_message").otherwise("assistant_message")
    event = identity.event_id(F.lit("gemini"), F.lit("1"), F.col("artifact"), F.lit(None).cast("string"), kind, F.col("session"), (F.col("i") + 1).cast("string"))
    none = F.lit(None).cast("string")
    return rows.select(F.lit("gemini").alias("family"), "artifact", "session", (F.col("i") + 1).alias("ordinal"), event.alias("event"), none.alias("native"),
        none.alias("parent"), none.alias("turn"), kind.alias("kind"), F.when(kind == "user_message", "user").otherwise("assistant").alias("role"),
        none.alias("call"), F.coalesce("m.content", F.lit("")).alias("text"), identity.utc_time(F.col("m.timestamp")).alias("at"), none.alias("kept"), F.lit(False).alias("side"))


def relations(events: DataFrame) -> DataFrame:
    """(kind, source, target): calls with results, turns with their members, parents with children (or side chains), summaries with what they compact or retain.

    A summary that names the first entry it keeps retains from there and compacts what lies before; one that does not
    compacts all before it. Results without a call, and calls without a result, have no relation."""
    key = ["artifact", "session"]
    e = materialize(events.select(*key, "event", "native", "parent", "turn", "kind", "call", "ordinal", "kept", "side"))
    calls = e.where("kind = 'tool_call' AND call IS NOT NULL").select(*key, "call", F.col("event").alias("source"))
    results = e.where("kind = 'tool_result' AND call IS NOT NULL").select(*key, "call", F.col("event").alias("target"))
    paired = calls.join(results, [*key, "call"]).select(F.lit("call_result").alias("kind"), "source", "target")
    anchors = e.where("turn IS NOT NULL").groupBy(*key, "turn").agg(F.min(F.struct("ordinal", "event")).alias("a"))
    members = e.where("turn IS NOT NULL").join(anchors, [*key, "turn"]).where("event <> a.event").select(F.lit("turn_membership").alias("kind"),
        F.col("a.event").alias("source"), F.col("event").alias("target"))
    firsts = e.where("native IS NOT NULL").groupBy(*key, "native").agg(F.min(F.struct("ordinal", "event")).alias("p"))
    children = e.where("parent IS NOT NULL").join(firsts.withColumnRenamed("native", "parent"),
        [*key, "parent"]).select(F.when(F.col("side"), "sidechain").otherwise("parent").alias("kind"), F.col("p.event").alias("source"), F.col("event").alias("target"))
    summaries = e.where("kind = 'compaction_summary'").select(*key, F.col("event").alias("summary"), F.col("ordinal").alias("at"), "kept")
    kept = firsts.select(*key, F.col("native").alias("kept"), F.col("p.ordinal").alias("from"))
    spans = e.select(*key, "event", "ordinal").join(summaries.join(kept, [*key, "kept"], "left"), key).where("ordinal < at")
    compacted = spans.select(F.when(F.col("ordinal") >= F.col("from"), "retained_from").otherwise("compacted_range").alias("kind"), F.col("summary").alias("source"), F.col("event").alias("target"))
    return paired.unionByName(members).unionByName(children).unionByName(compacted)
