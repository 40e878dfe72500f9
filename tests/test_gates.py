"""Gates and risk rules on given facts."""

from sparkloom.operators import gates

RESULTS = "run string, label string, route string, latency double"


def test_canary_gates(spark):
    good = [("good", "helpful", "knowledge", float(i)) for i in range(8)] + [("good", "missing", "fallback_raw", 400.0), ("good", "missing", "knowledge", 1.0)]
    rows = good + [("slow", "helpful", "knowledge", 501.0), ("stale", "helpful", "x", 1.0), ("stale", "stale", "x", 1.0), ("open", "helpful", "x", 1.0), ("open", None, "x", 1.0), ("lost", "helpful", "x", None)]
    rows += [("back", "helpful", "raw fallback", 1.0)] * 4 + [("back", "helpful", "x", 1.0)] * 6
    got = {r["run"]: r for r in gates.canary_gates(spark.createDataFrame(rows, RESULTS), "run").collect()}
    assert {k: r["status"] for k, r in got.items()} == {"good": "PASS", "slow": "FAIL", "stale": "FAIL", "open": "awaiting_labels", "lost": "FAIL", "back": "FAIL"}
    assert (got["good"]["helpful_rate"], got["good"]["fallback_rate"], got["good"]["p95"]) == (0.8, 0.1, 400.0) and got["lost"]["p95"] is None
    assert gates.canary_gates(spark.createDataFrame([], RESULTS), "run").count() == 0


def test_extraction_quality(spark):
    units = [("r", "skill", "Go", "q", "writes Go", "m1"), ("r", "skill", " go ", "q", "Writes go", None), ("r", "skill", "Go", "q", "mail anna@example.org", "m2"), ("r", None, "Go", "q", "x", ""), ("s", "skill", "a", None, None, "m3")]
    got = {r["run"]: r.asDict() for r in gates.extraction_quality(spark.createDataFrame(units, "run string, unit_type string, subject string, question string, answer string, evidence string"), "run").collect()}
    assert {k: got["r"][k] for k in ("units", "with_evidence", "complete", "repeats", "leaks", "repeats_rate")} == {"units": 4, "with_evidence": 2, "complete": 3, "repeats": 1, "leaks": 1, "repeats_rate": 0.25}
    assert got["s"]["complete"] == 0


def test_risks(spark):
    schema = "n int, kind string, direction string, status string, samples int, evidence int, confidence double"
    rows = [(1, "constraint", "up", "derived", 3, 1, 0.6), (2, "constraint", "down", "derived", 3, 1, 0.9), (3, "goal", "up", "uncertain", 2, 0, 0.59), (4, None, None, None, None, None, None)]
    got = {r["n"]: r for r in gates.risk(spark.createDataFrame(rows, schema), "increasing_constraint_pressure").collect()}
    assert (got[1]["risk_status"], got[1]["severity"], got[1]["risk_confidence"], got[1]["reasons"]) == ("derived", "medium", 0.6, [])
    assert got[2]["reasons"] == ["rule_not_matched"] and got[2]["risk_confidence"] == 0.0
    assert got[3]["reasons"] == got[4]["reasons"] == ["evidence_ineligible", "insufficient_samples", "rule_not_matched", "upstream_trend_uncertain", "weak_support"]


def test_goals(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from sparkloom.operators import coordination

    day = lambda n: datetime(2025, 5, n)
    goal = lambda n, domain="learning", target="run", confidence=0.9, seen=1, to=None, unresolved=False, sensitive=False: (n, domain, target, confidence, day(seen), day(to) if to else None, unresolved, sensitive, "s", "r")
    claim = lambda n, g, a=1, b=5, amount=6.0, kind="time", what="desk", unit="h", declared=None, run="r": (n, g, kind, what, unit, amount, 10.0, day(a), day(b), declared, "s", run)
    goals = [goal(1), goal(2, "career", " Run"), goal(3, "project"), goal(4, target=""), goal(5, confidence=1.5), goal(6, seen=20), goal(7, to=10), goal(8, unresolved=True), goal(9, "health", confidence=0.7), goal(10), goal(11), goal(12), goal(13, sensitive=None)]
    claims = [claim(1, 1), claim(2, 2, 4, 9), claim(3, 3, 5, 8), claim(4, 4, unit="d"), claim(5, 4, amount=4.0), claim(6, 1, what="lamp"), claim(7, 2, what="lamp"), claim(20, 10, kind="budget"), claim(21, 11, what=" "), claim(22, 12, run="other"), claim(23, 12, amount=-1.0)]
    g, c = spark.createDataFrame(goals, coordination.GOALS), spark.createDataFrame(claims, coordination.CLAIMS)
    wrong = {r["goal_id"]: r["reason"] for r in coordination.faults(g, c, F.lit(day(10))).collect()}
    assert wrong == {5: "invalid_confidence", 6: "future_observation", 7: "expired_input", 8: "unresolved_source_conflict", 9: "sensitive_or_insufficient", 10: "undeclared_financial_resource", 11: "invalid_resource_identity", 12: "resource_source_mismatch", 13: "sensitive_or_insufficient"}
    usable = g.where(F.col("goal_id") <= 4)
    clashes = coordination.conflicts(usable, c, days=2)
    assert sorted(map(tuple, clashes.collect())) == [(1, 2, 2, 0.9), (2, 3, 1, 0.9)]
    shared = coordination.opportunities(usable, clashes).collect()
    assert [(r["target"], r["first"], r["goals"], r["domains"], r["pairs"]) for r in shared] == [("run", 1, 3, 3, 1)]


def test_goals_whose_claims_share_an_id(spark):
    """Ids of claims may repeat; each pair of claims still counts once."""
    from datetime import datetime

    from sparkloom.operators import coordination

    day = lambda n: datetime(2025, 5, n)
    claim = lambda n, g, a, b, what: (n, g, "time", what, "h", 6.0, 10.0, day(a), day(b), None, "s", "r")
    goals = [(n, "learning", "run", 0.9, day(1), None, False, False, "s", "r") for n in (1, 2)]
    claims = [claim(7, 1, 1, 5, "desk"), claim(7, 1, 2, 6, "desk"), claim(8, 2, 3, 6, "desk"), claim(8, 2, 4, 7, "lamp"), claim(9, 1, 4, 5, "lamp")]
    g, c = spark.createDataFrame(goals, coordination.GOALS), spark.createDataFrame(claims, coordination.CLAIMS)
    assert [tuple(r) for r in coordination.conflicts(g, c, days=2).collect()] == [(1, 2, 3, 0.9)]
