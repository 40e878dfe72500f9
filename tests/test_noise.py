"""Notices: each reason, the edges of time, and both budgets against a walk over all candidates."""

import random
from datetime import datetime, timezone

import pytest

from sparkloom.operators import noise

SCHEMA = "id string, kind string, domains array<string>, dedup_key string, cooldown_key string, score double, urgency double, novelty double, sensitive boolean, evidence_eligible boolean, trust_eligible boolean, expires_at timestamp"
NOON = "2026-07-18T12:00:00Z"


def at(text):
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def candidate(id_, **changes):
    row = {"id": id_, "kind": "digest_item", "domains": ["health"], "dedup_key": f"d{id_}", "cooldown_key": f"c{id_}", "score": 0.7, "urgency": 0.5, "novelty": 1.0, "sensitive": False, "evidence_eligible": True, "trust_eligible": True, "expires_at": at("2026-07-20T00:00:00Z")}
    return tuple((row | changes).values())


def judged(spark, rows, shown=(), context=noise.Context(NOON), policy=noise.Policy()):
    frame = spark.createDataFrame(list(rows), SCHEMA)
    surfaced = spark.createDataFrame(list(shown), "key string, event_type string, at timestamp")
    return {r["id"]: (r["result"], r["reasons"], r["deferred_until"]) for r in noise.evaluate(frame, surfaced, context, policy).collect()}


def test_vetoes_in_their_order(spark):
    rows = [
        candidate("a", sensitive=True, evidence_eligible=False), candidate("b", evidence_eligible=None, trust_eligible=False), candidate("c", trust_eligible=False, expires_at=at("2026-07-18T11:00:00Z")),
        candidate("d", expires_at=at(NOON), score=0.1), candidate("e", score=0.1, novelty=0.0), candidate("f", novelty=0.0), candidate("g"), candidate("h", sensitive=None),
    ]
    got = judged(spark, rows, [("cf", "presented", at("2026-07-18T08:00:00Z"))])
    assert {k: v[1] for k, v in got.items()} == {"a": ["privacy_veto"], "b": ["evidence_veto"], "c": ["trust_veto"], "d": ["expired"], "e": ["below_threshold"], "f": ["duplicate_no_material_change"], "g": [], "h": ["privacy_veto"]}
    assert got["d"][0] == "expired" and got["g"][0] == "eligible" and got["f"][0] == "suppressed"


def test_cooldown_ends_on_the_hour_and_dismissals_do_not_start_it(spark):
    rows = [candidate(x) for x in "abc"]
    shown = [("ca", "presented", at("2026-07-17T12:00:01Z")), ("cb", "acknowledged", at("2026-07-17T12:00:00Z")), ("cc", "dismissed", at("2026-07-18T11:59:00Z"))]
    got = judged(spark, rows, shown, policy=noise.Policy(domain_budget=9))
    assert got["a"] == ("suppressed", ["cooldown_active"], None) and got["b"][0] == got["c"][0] == "eligible"


@pytest.mark.parametrize(("time", "until"), [("22:00:00", "2026-07-19T07:00:00Z"), ("06:59:59", "2026-07-18T07:00:00Z"), ("07:00:00", None), ("23:00:00", "2026-07-19T07:00:00Z")])
def test_quiet_hours(spark, time, until):
    got = judged(spark, [candidate("a")], context=noise.Context(f"2026-07-18T{time}Z"))
    assert got["a"] == (("deferred", ["quiet_period"], until) if until else ("eligible", [], None))


def test_unknown_zones_reach_the_inbox_only(spark):
    got = judged(spark, [candidate("a"), candidate("b", kind="inbox_item")], context=noise.Context("2026-07-18T23:00:00Z", "Mars/Olympus"))
    assert got["a"][1] == ["invalid_timezone_inbox_only"] and got["b"][0] == "eligible"
    assert noise.quiet_until(noise.Context("2026-07-18T15:30:00Z", "Asia/Shanghai"), noise.Policy()) == "2026-07-18T23:00:00Z"
    with pytest.raises(ValueError):
        noise.instant("2026-07-18T15:30:00")
    with pytest.raises(ValueError):
        judged(spark, [candidate("a")], context=noise.Context(NOON, window_start=NOON, window_end=NOON))


def test_user_vetoes_hold_for_critical_ones(spark):
    got = judged(spark, [candidate("a", score=1.0), candidate("b", score=1.0)], context=noise.Context(NOON, suppressed=("da",)), policy=noise.Policy(global_budget=0, domain_budget=0))
    assert got["a"] == ("abstained", ["trust_veto"], None) and got["b"][0] == "eligible"


def walked(rows, policy):
    used, of, out = 0, {}, {}
    for r in sorted(rows, key=lambda r: (-r[5], -r[6], r[0])):
        spent = [d for d in r[2] if of.get(d, 0) >= policy.domain_budget]
        critical = r[5] >= policy.critical and policy.critical_override
        if used >= policy.global_budget and not critical:
            out[r[0]] = ("suppressed", ["global_budget_exhausted"], None)
        elif spent and not critical:
            out[r[0]] = ("suppressed", ["domain_budget_exhausted", *spent], None)
        else:
            out[r[0]] = ("eligible", [], None)
            used += 1
            for d in r[2]:
                of[d] = of.get(d, 0) + 1
    return out


@pytest.mark.parametrize("policy", [noise.Policy(), noise.Policy(global_budget=12, domain_budget=3), noise.Policy(global_budget=5, domain_budget=9, critical=0.9), noise.Policy(global_budget=0), noise.Policy(domain_budget=0), noise.Policy(global_budget=8, domain_budget=4, critical=0.6, critical_override=False)])
def test_budgets_equal_a_walk(spark, policy):
    rng = random.Random(7)
    names = ["health", "learning", "project", "money"]
    rows = [candidate(f"{i:03d}", domains=sorted(rng.sample(names, rng.choice([1, 1, 2, 3]))), score=round(rng.choice([0.6, 0.7, 0.8, 0.92, 0.97]), 2), urgency=rng.choice([0.1, 0.5])) for i in range(120)]
    assert judged(spark, rows, policy=policy) == walked(rows, policy)


def test_importance(spark):
    parts = {n: i / 10 for i, n in enumerate(noise.WEIGHTS, 1)}
    row = spark.createDataFrame([tuple(parts.values())], ", ".join(f"{n} double" for n in parts))
    assert row.select(noise.importance()).first()[0] == round(sum(parts[n] * w for n, w in noise.WEIGHTS.items()), 6)
    assert datetime.now(timezone.utc).tzinfo is not None
