"""States that change by commits: conflicts, deaths half-way, maintained results, manifests, resumed builds, runs, paths."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import incremental, manifests, sequences
from sparkloom.sources.versioned import Conflict, Versioned, table_digest


@pytest.fixture
def store(spark, tmp_path):
    return Versioned(spark, f"file://{tmp_path}/store")


def numbers(spark, low, high, add=0):
    return spark.range(low, high).select(F.col("id").alias("k"), (F.col("id") + add).alias("v"))


def values(frame):
    return {r["k"]: r["v"] for r in frame.collect()}


def test_commits_are_whole_and_one_after_another(spark, store):
    empty = store.state()
    assert empty.version == 0 and store.read("t") is None
    first = store.commit(empty, {"t": store.stage("t", numbers(spark, 0, 50), "k", empty, 4)}, {"a": 1})
    late = store.stage("t", numbers(spark, 0, 50, 9), "k", empty, 4)
    with pytest.raises(Conflict):
        store.commit(empty, {"t": late}, {})
    assert values(store.read("t")) == {k: k for k in range(50)} and store.state() == first
    # One bucket is written again; the others keep their folders, and the state before can still be read.
    only = [1]
    rows = store.read("t", first, only).withColumn("v", F.lit(-1).cast("long"))
    second = store.commit(first, {"t": store.stage("t", rows, "k", first, only=only)}, {"b": 2})
    assert second.facts == {"a": 1, "b": 2}
    same = [b for b in first.tables["t"]["folders"] if first.tables["t"]["folders"][b] == second.tables["t"]["folders"].get(b)]
    assert set(same) == set(first.tables["t"]["folders"]) - {"1"}
    assert values(store.read("t", store.state(1))) == {k: k for k in range(50)}
    with pytest.raises(ValueError):
        store.stage("t", numbers(spark, 0, 50), "k", second, only=[2])
    with pytest.raises(Conflict):  # the name of a commit is taken once, whoever looked first
        store._commit_file = lambda version: f"{store.root}/commits/{2:012d}.json"
        store.commit(second, {}, {})


def test_digest_is_of_the_rows_and_not_of_their_order(spark):
    a = numbers(spark, 0, 20)
    assert table_digest(a) == table_digest(a.orderBy(F.desc("k")).repartition(3)) != table_digest(numbers(spark, 0, 20, 1))
    assert table_digest(a.limit(0)) != table_digest(a)


def summed(rows):
    return rows.groupBy("subject").agg(F.count("*").alias("n"), F.sum("x").alias("x"))


def test_maintained_results_equal_a_rebuild(spark, store):
    rng = random.Random(3)
    now = {f"r{i}": (f"s{i % 12}", i) for i in range(60)}
    frame = lambda: spark.createDataFrame([(r, s, x) for r, (s, x) in now.items()], "ref string, subject string, x long")
    kept = incremental.Maintained(store, summed, buckets=6)
    assert kept.refresh(frame(), ["x"], expected="")["changes"] == {"new": 60}
    for step in range(2):
        before, mark = store.state(), kept.watermark()
        touched = set()
        for r in rng.sample(sorted(now), 3):
            touched.add(now[r][0])
            if step == 0:
                now[r] = (now[r][0], rng.randrange(1000, 2000))
            elif rng.random() < 0.5:
                del now[r]
            else:
                now[r] = (f"s{rng.randrange(14)}", 5)
                touched.add(now[r][0])
        receipt = kept.refresh(frame(), ["x"], expected=mark)
        assert receipt["subjects"] == len(touched)
        assert sorted(map(tuple, kept.results().collect())) == sorted(map(tuple, summed(frame()).collect()))
        old, new = (s.tables["committed_results"]["folders"] for s in (before, store.state()))
        assert sum(old.get(b) != new.get(b) for b in set(old) | set(new)) <= receipt["buckets"] < 6
        with pytest.raises(Conflict):
            kept.refresh(frame(), ["x"], expected=mark)
    assert not kept.refresh(frame(), ["x"])["changed"]
    died = store.state()

    def fails(rows):
        raise RuntimeError("died")

    now["r1"] = ("s1", 77)
    with pytest.raises(RuntimeError):
        incremental.Maintained(store, fails, buckets=6).refresh(frame(), ["x"])
    assert store.state() == died


def test_affected_subjects(spark):
    changed = spark.createDataFrame([("a", "new", None, "s1"), ("b", "modified", "s2", "s3"), ("c", "deleted", "s4", None)], "ref string, change string, subject_before string, subject string")
    units = spark.createDataFrame([("b", "u1"), ("z", "u2"), ("c", None)], "ref string, subject string")
    assert {r[0] for r in incremental.affected_subjects(changed, units).collect()} == {"s1", "s2", "s3", "s4", "u1"}


UNIT = ("old", "current", 1, None, "q", "old answer")


@pytest.fixture
def ledger(spark, store):
    found = manifests.Ledger(store)
    found.start(spark.createDataFrame([UNIT, ("new", "current", 1, None, "q", "new answer"), ("third", "current", 4, None, "q", "x")], manifests.UNITS))
    return found


def action(spark, *changes, manifest="m1"):
    rows = []
    for n, c in enumerate(changes, 1):
        row = {"manifest_id": manifest, "ordinal": n, "unit_id": "old", "action": "supersede", "expected_version": 1, "expected_lifecycle": "current", "target": "new", "reason": "newer", "evidence": ["e1"], "question": None, "answer": None, "decision": "approve"}
        rows.append(tuple((row | c).values()))
    return spark.createDataFrame(rows, manifests.ACTIONS)


def unit(ledger, name="old"):
    return tuple(ledger.units().where(F.col("unit_id") == name).first())


def eligible(spark, *refs):
    return spark.createDataFrame([(r,) for r in refs or ("e1",)], "ref string")


def test_apply_and_take_back(spark, ledger):
    made = action(spark, {}, {"unit_id": "third", "action": "correct", "target": None, "expected_version": 4, "answer": "corrected"})
    with pytest.raises(manifests.Refused, match="not reviewed"):
        ledger.apply(made, eligible(spark))
    ledger.register(made, "Mary Reviewer")
    assert ledger.apply(made, eligible(spark)) == 2
    assert unit(ledger) == ("old", "superseded", 2, "new", "q", "old answer") and unit(ledger, "third")[1:] == ("current", 5, None, "q", "corrected")
    with pytest.raises(manifests.Refused):  # an applied one is not applied again
        ledger.apply(made, eligible(spark))
    assert ledger.rollback("m1") == 2
    assert unit(ledger) == ("old", "current", 3, None, "q", "old answer") and unit(ledger, "third")[1:] == ("current", 6, None, "q", "x")
    first, second = ledger.history("old").collect()
    assert second["action"] == "rollback" and second["rollback_of"] == first["event_id"] and ledger.status("m1") == "rolled_back"


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        ({"expected_version": 2}, "stale"), ({"expected_lifecycle": "conflict"}, "stale"), ({"unit_id": "none"}, "unit missing"), ({"target": "none"}, "target missing"), ({"target": None}, "target required"), ({"action": "burn"}, "unsupported"),
        ({"evidence": []}, "evidence required"), ({"evidence": ["e1", "lost"]}, "ineligible"), ({"reason": " "}, "reason"), ({"action": "correct"}, "changes invalid"), ({"answer": "x"}, "changes invalid"), ({"expected_version": None}, "expected version"),
    ],
)
def test_faults(spark, change, fault):
    units = spark.createDataFrame([UNIT, ("new", "current", 1, None, "q", "a")], manifests.UNITS)
    assert manifests.faults(action(spark, {}), units, eligible(spark)).count() == 0
    found = manifests.faults(action(spark, change), units, eligible(spark)).collect()
    assert len(found) == 1 and fault in found[0]["fault"]


def test_refusals_and_deaths_leave_no_trace(spark, ledger, store):
    made = action(spark, {"action": "conflict", "target": None})
    for reviewer in ("ab", "gpt reviewer", "Auto Bot"):
        with pytest.raises(manifests.Refused):
            ledger.register(made, reviewer)
    with pytest.raises(manifests.Refused):
        ledger.register(made, "some model", "llm", {"model_id": "m"})
    with pytest.raises(manifests.Refused):
        ledger.register(action(spark, {"decision": "pending"}), "Mary Reviewer")
    ledger.register(made, "some model", "llm", {"model_id": "m", "review_run_id": "r", "prompt_version": "p"})
    with pytest.raises(manifests.Refused, match="checksum"):
        ledger.apply(action(spark, {"action": "deprecate", "target": None}), eligible(spark))
    before = store.state()

    def dies():
        raise RuntimeError("died")

    with pytest.raises(RuntimeError):
        ledger.apply(made, eligible(spark), before_commit=dies)
    assert store.state() == before and unit(ledger) == UNIT and ledger.events().count() == 0
    ledger.apply(made, eligible(spark))
    later = action(spark, {"action": "restore", "target": None, "expected_version": 2, "expected_lifecycle": "conflict"}, manifest="m2")
    ledger.register(later, "Mary Reviewer")
    ledger.apply(later, eligible(spark))
    with pytest.raises(manifests.Refused, match="advanced"):
        ledger.rollback("m1")
    assert unit(ledger)[1:3] == ("current", 3)


def test_a_build_that_dies_is_taken_up_again(spark, store):
    rows, calls = numbers(spark, 0, 40).withColumnRenamed("k", "id"), []

    def embed(batch):
        calls.append(1)
        return batch.select("id", (F.col("v") * 2).alias("v"))

    def dies(batch):
        if batch == 1:
            raise RuntimeError("died")

    with pytest.raises(RuntimeError):
        incremental.build_resumable(store, "vectors", rows, embed, batches=4, after_batch=dies)
    assert store.state().facts["vectors_finished"] == [0, 1] and len(calls) == 2
    done = incremental.build_resumable(store, "vectors", rows, embed, batches=4)
    assert len(calls) == 4 and {r["id"]: r["v"] for r in done.collect()} == {i: 2 * i for i in range(40)} and done.count() == 40
    more = incremental.build_resumable(store, "vectors", rows.unionByName(numbers(spark, 99, 100).withColumnRenamed("k", "id")), embed)
    assert len(calls) == 5 and more.count() == 41


def test_runs(spark):
    rng = random.Random(5)
    rows = {(rng.choice(["a", "b", "hot", None]), rng.randrange(60)) for _ in range(150)} | {("hot", i) for i in range(200, 400)}
    rows = {r for r in rows if r[0]}
    want = {}
    for g, p in sorted(rows):
        key = next(((g, s) for (h, s), n in want.items() if h == g and s + n == p), (g, p))
        want[key] = want.get(key, 0) + 1
    frame = spark.createDataFrame(sorted(rows), "g string, p int").repartition(5)
    assert {(r["g"], r["start"]): r["length"] for r in sequences.runs(frame, "g", "p").collect()} == want
    assert sequences.consecutive(frame, "g", "p").count() == sum(n - 1 for n in want.values())
    assert sequences.runs(frame.limit(0), "g", "p").count() == 0


def test_longest_suffix(spark):
    left = spark.createDataFrame([(1, r"Agent\raw\x\log.jsonl"), (2, "y/log.jsonl"), (3, "other"), (4, None), (5, "./a//b/c")], "left int, path string")
    right = spark.createDataFrame([(10, "raw/x/log.jsonl"), (11, "z/x/log.jsonl"), (12, "q/log.jsonl"), (13, "b/c"), (14, "a/b/c")], "right int, path string")
    assert sorted(map(tuple, sequences.longest_suffix(left, right).collect())) == [(1, 10, 3, 1), (2, 10, 1, 3), (5, 14, 3, 1)]
