"""Reviewed manifests of changes to the lifecycle of units: applied whole or not at all, and taken back by linked events.

Units, events and manifests are tables of one versioned store. Actions are checked by joins against the units they were
written for (version and lifecycle as expected, a target that exists, evidence that is eligible); any fault refuses the
manifest. What passes is committed at once: changed units, one event an action, and the manifest's new status. Nothing
is deleted: taking a manifest back restores what each event says was there before, by an event that names it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import materialize
from sparkloom.sources.versioned import Versioned, bucket_of, table_digest

UNITS = "unit_id string, lifecycle string, version long, supersedes string, question string, answer string"
ACTIONS = "manifest_id string, ordinal int, unit_id string, action string, expected_version long, expected_lifecycle string, target string, reason string, evidence array<string>, question string, answer string, decision string"
EVENTS = "event_id string, manifest_id string, ordinal int, unit_id string, action string, rollback_of string, before struct<lifecycle:string,version:bigint,supersedes:string,question:string,answer:string>, after struct<lifecycle:string,version:bigint,supersedes:string,question:string,answer:string>"
MANIFESTS = "manifest_id string, status string, checksum string, actions long"
# The actions there are, the lifecycle each leads to, and words that no human reviewer's name has.
LIFECYCLES = {"supersede": "superseded", "conflict": "conflict", "deprecate": "deprecated", "restore": "current", "correct": None}
NO_HUMAN = re.compile(r"agent|codex|gpt|claude|gemini|synthetic|auto", re.I)
MOST_ACTIONS = 50
BUCKETS = 16
STATE = ("lifecycle", "version", "supersedes", "question", "answer")


class Refused(ValueError):
    """A manifest that isn't applied, with what is wrong."""


def check_reviewer(reviewer: str, kind: str = "human", provenance: dict | None = None) -> None:
    """Who may review: a human by name, or a model that says which, in which run, by which prompt."""
    if kind not in ("human", "llm") or len(reviewer.strip()) < 3:
        raise Refused("reviewer identity invalid")
    if kind == "human" and NO_HUMAN.search(reviewer):
        raise Refused("a human reviewer cannot bear the name of a model")
    if kind == "llm" and not all(str((provenance or {}).get(k) or "").strip() for k in ("model_id", "review_run_id", "prompt_version")):
        raise Refused("review provenance incomplete")


def manifest_checksum(actions: DataFrame) -> str:
    """A digest of one manifest's actions, each with its place."""
    return table_digest(actions.select(*[x.split()[0] for x in ACTIONS.split(", ")]))


def faults(actions: DataFrame, units: DataFrame, eligible: DataFrame) -> DataFrame:
    """(manifest_id, ordinal, unit_id, fault) of the actions that can't be applied to units; eligible(ref) is what counts as evidence.

    One fault an action, the first of: the action's own, the unit's, the target's, the evidence's."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    repeated = actions.groupBy("manifest_id", "unit_id").agg(F.count("*").alias("times"))
    refs = actions.select("manifest_id", "ordinal", F.explode(F.array_distinct("evidence")).alias("ref"))
    lost = refs.join(eligible.select("ref").distinct(), "ref", "left_anti").groupBy("manifest_id", "ordinal").agg(F.count("*").alias("lost"))
    now = units.select("unit_id", F.col("version").alias("now_version"), F.col("lifecycle").alias("now_lifecycle"))
    there = units.select(F.col("unit_id").alias("target"), F.lit(True).alias("target_there"))
    rows = actions.join(repeated, ["manifest_id", "unit_id"], "left").join(now, "unit_id", "left").join(there, "target", "left").join(lost, ["manifest_id", "ordinal"], "left")
    corrected = F.col("question").isNotNull() | F.col("answer").isNotNull()
    fault = (
        F.when(blank("unit_id") | (F.col("times") > 1), "missing or duplicate unit")
        .when(~F.coalesce(F.col("action").isin(*LIFECYCLES), F.lit(False)), "unsupported action")
        .when((F.coalesce("expected_version", F.lit(0)) < 1) | blank("expected_lifecycle"), "expected version and lifecycle required")
        .when(blank("reason"), "reason required")
        .when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "evidence required")
        .when((F.col("action") == "supersede") & blank("target"), "target required")
        .when((F.col("action") == "correct") != corrected, "changes invalid")
        .when(~F.col("decision").eqNullSafe("approve"), "approval required")
        .when(F.col("now_version").isNull(), "unit missing")
        .when((F.col("now_version") != F.col("expected_version")) | (F.col("now_lifecycle") != F.col("expected_lifecycle")), "stale version or lifecycle")
        .when((F.col("action") == "supersede") & F.col("target_there").isNull(), "target missing")
        .when(F.col("lost").isNotNull(), "evidence unresolved or ineligible")
    )
    return rows.select("manifest_id", "ordinal", "unit_id", fault.alias("fault")).where("fault IS NOT NULL")


def _state(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in STATE])


def _event_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("kle_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def applied(actions: DataFrame, units: DataFrame) -> DataFrame:
    """The events of actions on the units they name; what an action leaves alone stays."""
    to = F.create_map(*[F.lit(x) for pair in LIFECYCLES.items() if pair[1] for x in pair])
    rows = actions.withColumnsRenamed({"question": "new_question", "answer": "new_answer"}).join(units, "unit_id")
    lifecycle = F.coalesce(F.try_element_at(to, F.col("action")), F.col("lifecycle"))
    supersedes = F.when(F.col("action") == "supersede", F.col("target")).when(~F.col("action").isin("deprecate", "restore"), F.col("supersedes"))
    after = F.struct(lifecycle.alias("lifecycle"), (F.col("version") + 1).alias("version"), supersedes.alias("supersedes"),
        F.coalesce("new_question", "question").alias("question"), F.coalesce("new_answer", "answer").alias("answer"))
    return rows.select(_event_id("manifest_id", "unit_id", F.col("version").cast("string"), "action").alias("event_id"), "manifest_id", "ordinal", "unit_id",
        "action", F.lit(None).cast("string").alias("rollback_of"), _state().alias("before"), after.alias("after"))


def taken_back(events: DataFrame, units: DataFrame) -> DataFrame:
    """The events that undo events, each on its unit as it is now."""
    rows = events.where("rollback_of IS NULL").join(units, "unit_id")
    after = F.struct(F.col("before.lifecycle").alias("lifecycle"), (F.col("version") + 1).alias("version"), *[F.col(f"before.{c}").alias(c) for c in STATE[2:]])
    return rows.select(_event_id("event_id", F.lit("rollback")).alias("event_id"), "manifest_id", "ordinal", "unit_id", F.lit("rollback").alias("action"),
        F.col("event_id").alias("rollback_of"), _state().alias("before"), after.alias("after"))


def changed(units: DataFrame, events: DataFrame) -> DataFrame:
    """units after events, of which a unit has one at most."""
    new = events.select("unit_id", *[F.col(f"after.{c}").alias(c) for c in STATE])
    return units.join(new.select("unit_id"), "unit_id", "left_anti").unionByName(new)


class Ledger:
    """The units of a store with the manifests and events that changed them."""

    def __init__(self, store: Versioned):
        self.store, self.spark = store, store.spark

    def _table(self, name: str, schema: str, state, buckets: list[int] | None = None) -> DataFrame:
        found = self.store.read(name, state, buckets)
        return self.spark.createDataFrame([], schema) if found is None else found

    def units(self) -> DataFrame:
        return self._table("units", UNITS, self.store.state())

    def events(self) -> DataFrame:
        return self._table("events", EVENTS, self.store.state())

    def history(self, unit_id: str) -> DataFrame:
        """Events of a unit, the first first."""
        return self.events().where(F.col("unit_id") == unit_id).orderBy("before.version")

    def start(self, units: DataFrame) -> None:
        state = self.store.state()
        self.store.commit(state, {"units": self.store.stage("units", units, "unit_id", state, BUCKETS)}, {})

    def status(self, manifest_id: str) -> str | None:
        row = self._table("manifests", MANIFESTS, self.store.state()).where(F.col("manifest_id") == manifest_id).first()
        return row and row["status"]

    def register(self, actions: DataFrame, reviewer: str, kind: str = "human", provenance: dict | None = None, most: int | None = MOST_ACTIONS) -> None:
        """Store the reviewed checksum of one manifest, which is all that apply() will accept. ``most`` bounds what one review covers."""
        check_reviewer(reviewer, kind, provenance)
        ids = [r[0] for r in actions.select("manifest_id").distinct().limit(2).collect()]
        n = actions.count()
        if len(ids) != 1 or not ids[0] or most is not None and n > most:
            raise Refused("a manifest has one id and 1 to %s actions" % most)
        if actions.where("decision IS NULL OR decision <> 'approve'").head(1):
            raise Refused("every action needs an approval")
        if self.status(ids[0]):
            raise Refused("manifest is there already")
        self._commit([], [(ids[0], "reviewed", manifest_checksum(actions), n)])

    def apply(self, actions: DataFrame, eligible: DataFrame, before_commit=lambda: None) -> int:
        """Apply one registered manifest; the number of events. Raises Refused, or Conflict if another change came first."""
        manifest = actions.first()["manifest_id"]
        state = self.store.state()
        row = self._table("manifests", MANIFESTS, state).where(F.col("manifest_id") == manifest).first()
        if row is None or row["status"] != "reviewed":
            raise Refused("manifest is not reviewed")
        if row["checksum"] != manifest_checksum(actions):
            raise Refused("manifest checksum mismatch")
        units = self._table("units", UNITS, state)
        wrong = faults(actions, units, eligible).orderBy("ordinal").head(5)
        if wrong:
            raise Refused("; ".join(f"{r['ordinal']}: {r['fault']}" for r in wrong))
        events = materialize(applied(actions, units))
        return self._commit([events], [(manifest, "applied", row["checksum"], row["actions"])], state, before_commit)

    def rollback(self, manifest_id: str, before_commit=lambda: None) -> int:
        """Undo an applied manifest, unless one of its units has changed since."""
        state = self.store.state()
        row = self._table("manifests", MANIFESTS, state).where(F.col("manifest_id") == manifest_id).first()
        if row is None or row["status"] != "applied":
            raise Refused("only an applied manifest can be taken back")
        events = self._table("events", EVENTS, state).where((F.col("manifest_id") == manifest_id) & F.col("rollback_of").isNull())
        units = self._table("units", UNITS, state)
        moved = events.join(units.select("unit_id", F.col("version").alias("now")), "unit_id", "left").where("now IS NULL OR now <> after.version")
        if moved.head(1):
            raise Refused("a unit has advanced since")
        return self._commit([materialize(taken_back(events, units))], [(manifest_id, "rolled_back", row["checksum"], row["actions"])], state, before_commit)

    def _commit(self, events: list[DataFrame], manifests: list[tuple], state=None, before_commit=lambda: None) -> int:
        """Units, events and manifests in one commit, with only the buckets they change."""
        state = state or self.store.state()
        new = self.spark.createDataFrame(manifests, MANIFESTS)
        others = self._table("manifests", MANIFESTS, state).join(new.select("manifest_id"), "manifest_id", "left_anti")
        tables, n = {"manifests": self.store.stage("manifests", others.unionByName(new), "manifest_id", state, 1)}, 0
        for made in events:
            n = made.count()
            touched = [r[0] for r in made.select(bucket_of(F.col("unit_id"), BUCKETS)).distinct().collect()]
            tables["units"] = self.store.stage("units", changed(self._table("units", UNITS, state, touched), made), "unit_id", state, BUCKETS, touched)
            tables["events"] = self.store.stage("events", self._table("events", EVENTS, state, touched).unionByName(made), "unit_id", state, BUCKETS, touched)
        before_commit()
        self.store.commit(state, tables, {})
        return n
