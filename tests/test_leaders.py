"""Leader clusters against a loop over all rows, and what is made of them."""

import random
from pathlib import Path

import pytest

from sparkloom.operators import canonical, leaders
from sparkloom.sources import shared


def looped(rows, percent):
    """rows: (id, bucket, members), by the definition."""
    led, out = [], {}
    for i, b, m in sorted(rows):
        for j, c, n in led:
            if b == c and m and n and 100 * len(m & n) >= percent * len(m | n):
                out[i] = j
                break
        else:
            led.append((i, b, m))
            out[i] = i
    return out


def clustered(spark, rows, percent):
    frame = spark.createDataFrame([(i, b, list(m)) for i, b, m in rows], "id long, bucket string, members array<string>")
    return {r["id"]: r["leader"] for r in leaders.leader_clusters(frame, percent).collect()}


def drifting(rng, n, buckets):
    """Chains of sets that each differ a little from the one before, and loners."""
    rows, base = [], {}
    for i in range(n):
        b = f"b{rng.randrange(buckets)}"
        m = set(base.get(b, {f"x{k}" for k in range(12)}))
        if rng.random() < 0.2:
            m = {f"y{rng.randrange(60)}" for _ in range(12)}
        for _ in range(rng.randrange(3)):
            m.discard(rng.choice(sorted(m)) if m else None)
            m.add(f"x{rng.randrange(40)}")
        base[b] = m
        rows.append((i * 3 % 1009, b, frozenset(m)))
    return rows


@pytest.mark.parametrize(("seed", "percent"), [(1, 70), (2, 85)])
def test_leaders_equal_a_loop(spark, seed, percent):
    rows = drifting(random.Random(seed), 150, 3)
    got, want = clustered(spark, rows, percent), looped(rows, percent)
    assert got == want and len(set(want.values())) < len(rows)


def test_long_chains_are_walked(spark, monkeypatch):
    """Each row is like its neighbours only: leaders alternate, and no number of rounds is enough to see that early."""
    monkeypatch.setattr(leaders, "STAR_ROUNDS", 1)
    monkeypatch.setattr(leaders, "LINK_ROUNDS", 2)
    rows = [(i, "b", frozenset(f"m{k}" for k in range(3 * i, 3 * i + 10))) for i in range(40)]
    got, want = clustered(spark, rows, 50), looped(rows, 50)
    assert got == want and len(set(want.values())) > 10


def test_rounds_without_stars(spark, monkeypatch):
    monkeypatch.setattr(leaders, "STAR_ROUNDS", 0)
    rows = drifting(random.Random(5), 60, 2)
    assert clustered(spark, rows, 75) == looped(rows, 75)


def test_a_hot_group_and_odd_rows(spark):
    same = frozenset(f"m{k}" for k in range(20))
    rows = [(i, "hot", same) for i in range(100, 400)] + [(i, "hot", frozenset(same | {f"n{i}"})) for i in range(400, 500)] + [(1, "hot", frozenset()), (2, "hot", frozenset()), (3, None, same), (4, None, same)]
    got = clustered(spark, rows, 85)
    assert {got[i] for i in range(100, 500)} == {100} and got[1] == 1 and got[2] == 2 and got[3] == got[4] == 3
    assert clustered(spark, [], 85) == {}


UNITS = "id long, subject string, kind string, scope string, lifecycle string, question string, answer string, confidence double"


def units(spark):
    return spark.createDataFrame(
        [
            (1, "Shell ", "preference", None, "current", "which shell", "the user prefers the blue shell for all work", 0.9),
            (2, "shell", "preference", "user", "deprecated", "which shell", "the user prefers the blue shell for all work!", 0.7),
            (3, "shell", "preference", "user", "conflict", "which shell", "the user prefers the blue shell for all work", 0.8),
            (4, "shell", "skill", "user", "current", "which shell", "the user prefers the blue shell for all work", 0.6),
            (5, "shell", "preference", "user", "current", "other", "nothing alike at all", 0.5),
        ],
        UNITS,
    )


def test_buckets_reducer_and_gate(spark):
    rows = units(spark)
    found = canonical.members(rows)
    assert {r["id"]: r["leader"] for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    made = {r["leader"]: r for r in canonical.canonical_units(rows, found).collect()}
    assert (made[1]["best"], made[1]["confidence"], made[1]["lifecycle"], made[1]["n_members"], made[1]["merge_reason"]) == (2, 0.7, "deprecated", 2, "similar_merge")
    assert made[3]["lifecycle"] == "conflict" and made[5]["merge_reason"] == "single"
    pairs = lambda *p: spark.createDataFrame(list(p), "a string, b string")
    evidence = spark.createDataFrame([("m1", 1), ("m1", 5), ("m2", 2), ("m4", 4), ("m5", 5)], "ref string, id long")
    good = canonical.merge_gate(found, evidence, pairs(("m1", "m2"), ("m1", "lost")), pairs(("m2", "m4"))).first()
    assert (good["positives"], good["merged_positives"], good["negatives"], good["false_merges"], good["unresolved"], good["recall"], good["verdict"]) == (1, 1, 1, 0, 1, 1.0, "passed")
    assert canonical.merge_gate(found, evidence, pairs(("m1", "m2"), ("m2", "m5")), pairs(("m2", "m4"))).first()["verdict"] == "failed"
    assert canonical.merge_gate(found, evidence, pairs(("m1", "m2")), pairs(("m1", "m5"))).first()["false_merges"] == 1
    assert canonical.merge_gate(found, evidence, pairs(("x", "y")), pairs(("m2", "m4"))).first()["verdict"] == "not_applicable"


def test_sets_are_not_written(spark):
    """Only sketches are written and sent of sets that are like none, not their members; windows of strings are sets too."""
    rng = random.Random(9)
    rows = [(i, "b", frozenset(f"m{rng.randrange(10**9)}" for _ in range(500))) for i in range(200)]
    with shared.temporary_tables(spark) as paths:
        got = clustered(spark, rows, 85)
        written = sum(f.stat().st_size for p in paths for f in Path(p.removeprefix("file:")).rglob("*.parquet"))
    assert got == {i: i for i, _, _ in rows} and written < 200 * 500 * 4
    texts = spark.createDataFrame([(1, "b", "the blue shell"), (2, "b", "the blue shell."), (3, "b", "the red shell")], "id long, bucket string, members string")
    assert {r["id"]: r["leader"] for r in leaders.leader_clusters(texts, 85).collect()} == {1: 1, 2: 1, 3: 3}
