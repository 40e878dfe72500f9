"""Folds over event logs: state machines, cooldowns, control overlays, chains and watermarks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The legal moves of a confirmation and of an action, by state.
CONFIRMATIONS = {("proposed", "accept"): "accepted", ("proposed", "reject"): "rejected", ("proposed", "defer"): "deferred", ("deferred", "accept"): "accepted",
    ("deferred", "reject"): "rejected", ("deferred", "defer"): "deferred", ("accepted", "revoke_before_action"): "revoked"}
ACTIONS = {(None, "planned"), (None, "not_taken"), ("planned", "started"), ("planned", "abandoned"), ("planned", "not_taken"), ("started", "completed"), ("started", "abandoned")}
# Controls that deny, and what each says.
DENIALS = {"suppress": "suppressed_by_user", "snooze": "snoozed_by_user", "revoke": "revoked_by_user"}


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """One output row per row, folded in order within each key: step(state or None, row) -> (state, output tuple).

    Keys are brought together and sorted by Spark; a task streams over its sorted rows and holds the state of one key,
    so a key of any size is folded in bounded memory."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches):
        current, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, None
                state, result = step(state, row)
                out.append(result)
            yield pa.record_batch([pa.array([r[i] for r in out], type=kinds.field(n).type) for i, n in enumerate(names)], names=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def decisions(log: DataFrame) -> DataFrame:
    """(subject, seq, confirmation, action, legal) after each of log(subject, seq, kind, value): kind is confirmation or action.

    An illegal move changes nothing and is told."""

    def step(state, row):
        confirmation, action = state or ("proposed", None)
        legal = True
        if row["kind"] == "confirmation":
            to = CONFIRMATIONS.get((confirmation, row["value"]))
            legal = to is not None and not (row["value"] == "revoke_before_action" and action is not None)
            confirmation = to if legal else confirmation
        elif row["kind"] == "action":
            legal = confirmation == "accepted" and (action, row["value"]) in ACTIONS
            action = row["value"] if legal else action
        return (confirmation, action), (row["subject"], row["seq"], confirmation, action, legal)

    return ordered_fold(log.select("subject", "seq", "kind", "value"), ["subject"], ["seq"], step, "subject long, seq long, confirmation string, action string, legal boolean")


def surfaced(rows: DataFrame, hours: int) -> DataFrame:
    """Rows(key, at, id) with whether each is surfaced: only so many hours after the last one of its key that was."""

    def step(last, row):
        shown = last is None or (row["at"] - last).total_seconds() >= hours * 3600
        return (row["at"] if shown else last), (row["key"], row["id"], shown)

    return ordered_fold(rows.select("key", "at", "id"), ["key"], ["at", "id"], step, "key string, id long, shown boolean")


def verify_chain(log: DataFrame) -> DataFrame:
    """Per chain of log(chain, seq, checksum, previous): its length, first fault and kind of fault, and its head.

    A sequence begins at 1 without a predecessor and has no gap; each entry names the checksum of the one before."""
    order = Window.partitionBy("chain").orderBy("seq")
    before = log.withColumn("last_seq", F.lag("seq", 1, 0).over(order)).withColumn("last_sum", F.lag("checksum", 1, "genesis").over(order))
    fault = F.when(F.col("seq") != F.col("last_seq") + 1, "event_sequence_invalid").when(~F.col("previous").eqNullSafe(F.col("last_sum")), "event_chain_mismatch")
    judged = before.withColumn("fault", fault)
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("seq", "fault")))
    return judged.groupBy("chain").agg(F.count("*").alias("n"), first.alias("f"), F.max_by("checksum", "seq").alias("head")).select("chain", "n",
        F.col("f.seq").alias("first_fault"), F.col("f.fault").alias("fault"), "head")


def controls_as_of(log: DataFrame, instant: str) -> DataFrame:
    """Per target of log(target, event, at, operation, expires, undoes): eligible, reason, the winning event and the active ones.

    Restored and expired controls and those still to come don't count; a denial wins over all else, the latest of several."""
    now = F.lit(instant).cast("timestamp_ntz")
    known = log.where(F.col("at") <= now)
    undone = known.where("operation = 'restore'").select(F.col("undoes").alias("event")).distinct()
    active = known.where("operation <> 'restore'").where(F.col("expires").isNull() | (now < F.col("expires"))).join(undone, "event", "left_anti")
    at = F.struct("at", "event")
    denial = F.col("operation").isin(*DENIALS)
    counted = ~F.col("operation").isin("correct", "mark_not_useful", "mark_wrong_timing")
    state = active.groupBy("target").agg(
        F.max(F.when(denial, F.struct("at", "event", "operation"))).alias("denial"),
        F.max(F.when(counted, F.struct("at", "event", "operation"))).alias("latest"),
        F.count_distinct(F.when(counted & ~denial, F.col("operation"))).alias("kinds"),
        F.bool_or(F.col("operation") == "correct").alias("correction"),
        F.array_sort(F.collect_set("event")).alias("active"),
    )
    unclear = F.col("denial").isNull() & (F.col("kinds") > 1)
    reason = F.when(unclear, "ambiguous_control")
    for operation, why in DENIALS.items():
        reason = reason.when(F.col("denial.operation") == operation, why)
    found = log.select("target").distinct().join(state, "target", "left")
    winner = F.when(unclear, F.lit(None)).otherwise(F.coalesce("denial.event", "latest.event"))
    return found.select("target", reason.isNull().alias("eligible"), reason.alias("reason"), winner.alias("winner"),
        F.coalesce("correction", F.lit(False)).alias("correction"), F.coalesce(F.size("active"), F.lit(0)).alias("n_active"))


def watermark_check(items: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Per run of items(run, ref, status): unfinished, failures nobody acknowledged(run, ref), and whether the watermark may move."""
    failed = items.where("status = 'failed'").join(acknowledged.select("run", "ref").distinct(), ["run", "ref"], "left_anti").groupBy("run").agg(F.count("*").alias("unacknowledged"))
    totals = items.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("pending", "in_flight", "retryable")).alias("unfinished"))
    rows = totals.join(failed, "run", "left").withColumn("unacknowledged", F.coalesce("unacknowledged", F.lit(0).cast("long")))
    return rows.withColumn("ok", (F.col("unfinished") == 0) & (F.col("unacknowledged") == 0))
