"""Which candidates for a notice are shown: vetoes, expiry, threshold, repeats, cooldown, quiet hours, and two budgets.

All but the budgets look at one candidate and are columns. Budgets feed back: a candidate is accepted, in the order of
score, urgency and id, while the global budget and the budgets of all its domains last, and then uses one of each; a
rejected one uses none and frees none. Critical ones are accepted beyond any budget and use it up all the same.

Nobody has to walk through all candidates for that. Of candidates with the same set of domains, once one is rejected so
is every later one, so of each set the first few (as many as the larger budget) of both kinds decide where each budget
ends. These few are walked; then every candidate compares its place with those ends. Sets of domains are subsets of a
short list, so the rows walked are bounded by the policy and not by the candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The weights of the parts of a score, the domains there are, and what counts as having been shown.
WEIGHTS = {"severity": 0.18, "urgency": 0.18, "goal_impact": 0.14, "cross_domain_impact": 0.10, "novelty": 0.15, "evidence_strength": 0.15, "user_relevance": 0.08, "outcome_signal": 0.02}
SHOWN = ("presented", "acknowledged")


@dataclass(frozen=True)
class Policy:
    threshold: float = 0.55
    cooldown_hours: int = 24
    quiet_start: int = 22
    quiet_end: int = 7
    global_budget: int = 3
    domain_budget: int = 2
    critical: float = 0.95
    critical_override: bool = True


@dataclass(frozen=True)
class Context:
    """When it is judged, for a user in which zone, and what they want to hear no more of."""

    as_of: str
    zone: str = "UTC"
    window_start: str | None = None
    window_end: str | None = None
    suppressed: tuple[str, ...] = ()


def instant(text: str) -> datetime:
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if at.tzinfo is None:
        raise ValueError("a time needs its zone")
    return at.astimezone(UTC)


def importance() -> Column:
    """The weighted score of the parts, each a column from 0 to 1, rounded to 6 places."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.round(F.col(name), 6) * F.lit(weight)
    return F.round(total, 6)


def quiet_until(context: Context, policy: Policy) -> str | None:
    """When the quiet hours of the user's zone end, if it is in them; None outside them or in no known zone."""
    try:
        local = instant(context.as_of).astimezone(ZoneInfo(context.zone))
    except (KeyError, ValueError, OSError):
        return None
    if policy.quiet_end <= local.hour < policy.quiet_start:
        return None
    day = local + timedelta(days=1) if local.hour >= policy.quiet_start else local
    return day.replace(hour=policy.quiet_end, minute=0, second=0, microsecond=0).astimezone(UTC).isoformat().replace("+00:00", "Z")


def _known_zone(zone: str) -> bool:
    try:
        ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        return False
    return True


def _ends(ordered: DataFrame, policy: Policy) -> tuple[tuple | None, dict[str, tuple]]:
    """The place (score, urgency, id) after which the global budget is used up, and those of the domains; absent where it lasts.

    A place None means from the start. ordered(score, urgency, id, domains, critical)."""
    few = max(policy.global_budget, policy.domain_budget, 1)
    best = Window.partitionBy("domains", "critical").orderBy(F.desc("score"), F.desc("urgency"), "id")
    rows = ordered.withColumn("n", F.row_number().over(best)).where(F.col("n") <= few).drop("n").collect()
    used, of = 0, {}
    whole = () if policy.global_budget <= 0 else None
    parts: dict[str, tuple] = {}
    for r in sorted(rows, key=lambda r: (-r["score"], -r["urgency"], r["id"])):
        spent = policy.domain_budget <= 0 and r["domains"] or [d for d in r["domains"] if of.get(d, 0) >= policy.domain_budget]
        if not r["critical"] and (used >= policy.global_budget or spent):
            continue
        used += 1
        place = (r["score"], r["urgency"], r["id"])
        if used == policy.global_budget:
            whole = place
        for d in r["domains"]:
            of[d] = of.get(d, 0) + 1
            if of[d] == policy.domain_budget:
                parts[d] = place
    return whole, parts


def _behind(place: tuple) -> Column:
    """Whether a row comes after a place in the order."""
    if not place:
        return F.lit(True)
    score, urgency, id_ = (F.lit(x) for x in place)
    later = (F.col("urgency") < urgency) | (F.col("urgency") == urgency) & (F.col("id") > id_)
    return (F.col("score") < score) | (F.col("score") == score) & later


def evaluate(candidates: DataFrame, surfaced: DataFrame, context: Context, policy: Policy = Policy()) -> DataFrame:
    """(id, result, reasons, deferred_until) of every candidate.

    candidates(id, kind, domains array<string> sorted, dedup_key, cooldown_key, score, urgency, novelty, sensitive,
    evidence_eligible, trust_eligible, expires_at timestamp); surfaced(key, event_type, at timestamp) is what was shown.
    A null flag counts as the cautious side: sensitive, not eligible."""
    now = instant(context.as_of)
    if context.window_start and context.window_end and not instant(context.window_start) <= now < instant(context.window_end):
        raise ValueError("the time lies outside the window")
    at, until = F.lit(now), quiet_until(context, policy)
    shown = surfaced.where(F.col("event_type").isin(*SHOWN)).groupBy(F.col("key").alias("cooldown_key")).agg(F.max("at").alias("shown"))
    rows = candidates.join(shown, "cooldown_key", "left")
    outcome = lambda result, *reasons: F.struct(F.lit(result).alias("result"), F.array(*[F.lit(r) for r in reasons]).cast("array<string>").alias("reasons"))
    cooling = F.col("shown").isNotNull() & (F.unix_micros(at) - F.unix_micros("shown") < policy.cooldown_hours * 3_600_000_000)
    first = (
        F.when(F.coalesce("sensitive", F.lit(True)), outcome("abstained", "privacy_veto"))
        .when(~F.coalesce("evidence_eligible", F.lit(False)), outcome("abstained", "evidence_veto"))
        .when(~F.coalesce("trust_eligible", F.lit(False)) | F.coalesce(F.col("dedup_key").isin(*context.suppressed) if context.suppressed else F.lit(False),
            F.lit(False)), outcome("abstained", "trust_veto"))
        .when(at >= F.col("expires_at"), outcome("expired", "expired"))
        .when(F.lit(not _known_zone(context.zone)) & (F.col("kind") != "inbox_item"), outcome("abstained", "invalid_timezone_inbox_only"))
        .when(F.col("score") < policy.threshold, outcome("abstained", "below_threshold"))
        .when(F.col("novelty") == 0, outcome("suppressed", "duplicate_no_material_change"))
        .when(cooling, outcome("suppressed", "cooldown_active"))
        .when(F.lit(until is not None), outcome("deferred", "quiet_period"))
    )
    critical = (F.col("score") >= policy.critical) & F.lit(policy.critical_override)
    rows = rows.withColumn("first", first).withColumn("critical", critical)
    whole, parts = _ends(rows.where("first IS NULL").select("score", "urgency", "id", "domains", "critical"), policy)
    if policy.domain_budget <= 0:
        spent = F.col("domains")
    else:
        ended = F.array(*[F.when(_behind(p), F.lit(d)) for d, p in sorted(parts.items())]).cast("array<string>")
        spent = F.filter("domains", lambda d: F.array_contains(F.array_compact(ended), d))
    last = (
        F.when(F.col("critical"), outcome("eligible"))
        .when(_behind(whole) if whole is not None else F.lit(False), outcome("suppressed", "global_budget_exhausted"))
        .when(F.size(spent) > 0, F.struct(F.lit("suppressed").alias("result"), F.concat(F.array(F.lit("domain_budget_exhausted")), spent).alias("reasons")))
        .otherwise(outcome("eligible"))
    )
    out = rows.select("id", F.coalesce("first", last).alias("o"))
    return out.select("id", "o.result", "o.reasons", F.when(F.col("o.result") == "deferred", F.lit(until)).alias("deferred_until"))
