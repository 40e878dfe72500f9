"""Results by subject that follow their source: only subjects with changed rows are computed again.

The state is a commit of an inventory (reference, subject, content hash), the results, and the checksum of the inventory
as a watermark for each track. A refresh compares inventories, computes the affected subjects, rewrites the buckets they
lie in and commits all of it at once; if another refresh came first, or the watermark isn't the expected one, nothing
happens. A refresh that dies leaves the state as it was and can be run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import materialize
from sparkloom.sources.versioned import Conflict, State, Versioned, bucket_of, table_digest

BUCKETS = 16


def changes(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """(ref, change, subject_before, subject) of the references that are new, modified or deleted."""
    if before is None:
        return after.select("ref", F.lit("new").alias("change"), F.lit(None).cast("string").alias("subject_before"), "subject")
    old = before.select("ref", F.col("subject").alias("subject_before"), F.col("hash").alias("hash_before"), F.lit(True).alias("was"))
    both = old.join(after.withColumn("is", F.lit(True)), "ref", "full_outer")
    moved = ~F.col("hash").eqNullSafe(F.col("hash_before")) | ~F.col("subject").eqNullSafe(F.col("subject_before"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(moved, "modified")
    return both.select("ref", change.alias("change"), "subject_before", "subject").where("change IS NOT NULL")


def affected_subjects(changed: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(subject) that any changed reference belonged to, belongs to, or is evidence for in units(ref, subject)."""
    own = changed.select(F.explode(F.array("subject_before", "subject")).alias("subject"))
    if units is not None:
        own = own.unionByName(units.join(changed.select("ref").distinct(), "ref", "left_semi").select("subject"))
    return own.where("subject IS NOT NULL").distinct()


def _buckets(keys: DataFrame, key: str, buckets: int) -> list[int]:
    return [r["b"] for r in keys.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect()]


class Maintained:
    """build takes rows of whole subjects and returns (subject, ...), which depends on the rows of that subject only."""

    def __init__(self, store: Versioned, build: Callable[[DataFrame], DataFrame], track: str = "committed", buckets: int = BUCKETS):
        self.store, self.build, self.track, self.buckets = store, build, track, buckets
        self._inventory, self._results = f"{track}_inventory", f"{track}_results"

    def watermark(self, state: State | None = None) -> str:
        return (state or self.store.state()).facts.get(self.track, "")

    def results(self, state: State | None = None) -> DataFrame | None:
        return self.store.read(self._results, state)

    def refresh(self, rows: DataFrame, content: Iterable[Column | str], expected: str | None = None) -> dict:
        """Bring the results up to rows(ref, subject, ...), told apart by ``content``; rows without a reference or subject take no part.

        References are unique. With ``expected`` the watermark must be that one."""
        state = self.store.state()
        if expected is not None and expected != self.watermark(state):
            raise Conflict("the watermark has moved")
        rows = rows.where("ref IS NOT NULL AND subject IS NOT NULL")
        digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
        inventory = materialize(rows.select(F.col("ref").cast("string"), F.col("subject").cast("string"), digest.alias("hash")))
        reached = table_digest(inventory)
        if reached == self.watermark(state) and self._results in state.tables:
            return {"changed": False, "watermark": reached, "changes": {}, "subjects": 0, "buckets": 0}
        changed = materialize(changes(self.store.read(self._inventory, state), inventory))
        subjects = materialize(affected_subjects(changed))
        refs_in, subjects_in = _buckets(changed, "ref", self.buckets), _buckets(subjects, "subject", self.buckets)
        here = inventory.where(bucket_of(F.col("ref"), self.buckets).isin(refs_in))
        fresh = self.build(rows.join(subjects, "subject", "left_semi"))
        old = self.store.read(self._results, state, subjects_in)
        if old is not None:
            fresh = old.join(subjects, "subject", "left_anti").unionByName(fresh)
        tables = {
            self._inventory: self.store.stage(self._inventory, here, "ref", state, self.buckets, refs_in),
            self._results: self.store.stage(self._results, fresh, "subject", state, self.buckets, subjects_in),
        }
        self.store.commit(state, tables, {self.track: reached})
        counts = {r["change"]: r["count"] for r in changed.groupBy("change").count().collect()}
        return {"changed": True, "watermark": reached, "changes": counts, "subjects": subjects.count(), "buckets": len(subjects_in)}


def build_resumable(store: Versioned, name: str, rows: DataFrame, embed: Callable[[DataFrame], DataFrame], batches: int = BUCKETS, after_batch: Callable[[int], None] = lambda done: None) -> DataFrame:
    """embed(rows(id, ...)) of all rows, in batches by a hash of the id, each committed with its results.

    What is committed is what is done: a run that dies computes the batch it was in again, and no other, so no row is
    there twice or missing. Rows that are in a finished batch but new to it are added, those that have gone stay."""
    state = store.state()
    known = state.tables.get(name)
    batches = known["buckets"] if known else batches
    finished = f"{name}_finished"
    for batch in range(batches):
        state = store.state()
        mine = rows.where(bucket_of(F.col("id"), batches) == batch)
        if batch in state.facts.get(finished, []):
            mine = mine.join(store.read(name, state, [batch]).select("id"), "id", "left_anti")
            if mine.isEmpty():
                continue
            done = store.read(name, state, [batch]).unionByName(embed(mine))
        else:
            done = embed(mine)
        table = store.stage(name, done, "id", state, batches, [batch])
        store.commit(state, {name: table}, {finished: sorted({*state.facts.get(finished, []), batch})})
        after_batch(batch)
    return store.read(name)
