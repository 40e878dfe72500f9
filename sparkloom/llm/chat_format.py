"""Chat formatting from an event log: fold deltas, edits and regenerations, then render with a loss mask.

A log row is (conv, seq, message, kind, role, text). Kinds: ``delta`` appends its text to the message; ``edit``
and ``regenerate`` drop what the message held and start again from their own text; ``delete`` empties and hides
the message until a later event restores it. Messages are ordered by their number, events by seq; events of one seq
follow each other by kind (in the order delta, delete, edit, regenerate), role and text. The last non-null role of a
message holds.

A turn is rendered ``<s>role\\ntext</s>``. Inside roles and texts ``\\`` becomes ``\\e``, ``<`` becomes ``\\l``,
``[`` becomes ``\\b`` (and in roles a line feed becomes ``\\n``), so no control string can arise from a text, and
each escape can be undone. The mask names, per assistant turn, the turn's place and the code points of its text
inside the rendered turn. Everything is DataFrame functions.

Defined cases: a null text or role counts as empty; a null conversation id is one conversation; an empty log gives
no rows; repeated log rows are separate events, so a repeated delta appends twice, while a repeated edit, regeneration
or deletion changes nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Character and its escape, in the order of escaping; undone in reverse.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def _replaced(col: Column, pairs) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def escape(col: Column, pairs=ESCAPES) -> Column:
    return _replaced(col, pairs)


def unescape(col: Column, pairs=ESCAPES) -> Column:
    return _replaced(col, [(new, old) for old, new in reversed(pairs)])


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log of a chat service in which every row is a message of its own.

    An assistant's message starts as a draft of half its text, is regenerated, and streams in two deltas; any other
    one is typed up to its half and then edited. The log folds back to the rows."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    first, rest = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    event = lambda i, kind, text: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(event(0, "delta", first), event(1, "regenerate", first), event(2, "delta", rest))
    typed = F.array(event(0, "delta", first), event(1, "edit", F.col("text")))
    events = rows.select("conv", "message", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("e"))
    return events.select("conv", (4 * F.col("message") + F.col("e.i")).alias("seq"), "e.kind", "role", "e.text", "message")


def fold_messages(log: DataFrame) -> DataFrame:
    """The messages (conv, message, role, text) that a log ends with."""
    events = log.select("conv", "seq", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    folded = events.groupBy("conv", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("events"))
    # The place (from 1) of the last event that starts the message again; 0 where there is none.
    starts = F.transform("events", lambda e, i: F.when(e["kind"].isin("edit", "regenerate", "delete"), i + 1).otherwise(0))
    live = F.slice("events", F.greatest(F.array_max(starts), F.lit(1)), F.size("events"))
    folded = folded.withColumn("live", live).where((F.size("live") > 1) | (F.col("live")[0]["kind"] != "delete"))
    text = F.array_join(F.transform(F.filter("live", lambda e: e["kind"] != "delete"), lambda e: e["text"]), "")
    roles = F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull())
    return folded.select("conv", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, formatted, loss_mask): the rendered conversation, and array<struct<turn, start, end>> under the loss."""
    head = F.concat(F.lit("<s>"), escape(F.col("role"), ROLE_ESCAPES), F.lit("\n"))
    body = escape(F.col("text"))
    turn = messages.select(
        "conv",
        F.struct(
            F.col("message"),
            F.concat(head, body, F.lit("</s>")).alias("rendered"),
            F.col("role").isin(*loss_roles).alias("loss"),
            F.char_length(head).alias("start"),
            (F.char_length(head) + F.char_length(body)).alias("end"),
        ).alias("turn"),
    )
    turns = turn.groupBy("conv").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    mask = F.filter(
        F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["end"].alias("end"), t["loss"].alias("loss"))),
        lambda s: s["loss"],
    )
    return turns.select(
        "conv",
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform(mask, lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["end"].alias("end"))).alias("loss_mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv, formatted, turns array<struct<role, text>>, loss_text) from the formatted string and its mask."""
    pieces = F.filter(F.split("formatted", "</s>", -1), lambda p: p != "")
    turns = F.transform(
        "pieces",
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(4)), "\n", 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )
    loss = F.transform("loss_mask", lambda s: unescape(F.substr(F.col("pieces")[s["turn"]], s["start"] + 1, s["end"] - s["start"])))
    return rendered.withColumn("pieces", pieces).select("conv", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def format_chats(log: DataFrame) -> DataFrame:
    """Fold a log and render it: (conv, formatted, loss_mask)."""
    return render(fold_messages(log))
