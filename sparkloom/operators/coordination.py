"""Goals that compete for a resource, and goals of different domains that share a target.

Goals are judged one by one first; a goal with a fault takes part in nothing and says why. Two goals of one snapshot and
run conflict where they claim the same resource, in the same unit, at overlapping times, and together want more than
either says there is. Claims meet by resource and time, so only pairs that do overlap are ever built. Goals that share a
target and don't conflict are opportunities for each other; as any number may share one, they come as one class with its
first goal, members and number of pairs, and not as all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import relational

GOALS = "goal_id long, domain string, target string, confidence double, observed_at timestamp, valid_to timestamp, unresolved boolean, sensitive boolean, snapshot string, run string"
CLAIMS = "claim_id long, goal_id long, type string, resource_id string, unit string, amount double, capacity double, start timestamp, end timestamp, declared boolean, snapshot string, run string"
# Kinds of resources, and domains in which a goal needs more confidence.
RESOURCES = ("time", "energy", "budget")
DELICATE, LEAST_DELICATE = ("health", "finance", "relationship"), 0.75


def faults(goals: DataFrame, claims: DataFrame, as_of: Column, resources: tuple[str, ...] = RESOURCES, delicate: tuple[str, ...] = DELICATE) -> DataFrame:
    """(goal_id, reason) of the goals that can't be used: the goal's own first fault, else that of its first faulty claim.

    A null confidence, flag or amount counts as a fault."""
    yes = lambda c: F.coalesce(c, F.lit(True))
    no = lambda c: F.coalesce(c, F.lit(False))
    own = (
        F.when(~no(F.col("confidence").between(0, 1)), "invalid_confidence")
        .when(yes(F.col("observed_at") > as_of), "future_observation")
        .when(no(F.col("valid_to") <= as_of), "expired_input")
        .when(yes(F.col("unresolved")), "unresolved_source_conflict")
        .when(yes(F.col("sensitive")) | (F.col("domain").isin(*delicate) & (F.col("confidence") < LEAST_DELICATE)), "sensitive_or_insufficient")
    )
    with_goal = claims.join(goals.select("goal_id", F.col("snapshot").alias("own_snapshot"), F.col("run").alias("own_run")), "goal_id")
    claim = (
        F.when(~no(F.col("type").isin(*resources)) | ~no(F.col("amount") >= 0) | ~no(F.col("capacity") >= 0), "invalid_resource")
        .when(F.trim(F.coalesce("resource_id", F.lit(""))) == "", "invalid_resource_identity")
        .when(~F.col("snapshot").eqNullSafe(F.col("own_snapshot")) | ~F.col("run").eqNullSafe(F.col("own_run")), "resource_source_mismatch")
        .when((F.col("type") == "budget") & ~no(F.col("declared")), "undeclared_financial_resource")
    )
    first = with_goal.withColumn("fault", claim).where("fault IS NOT NULL").groupBy("goal_id").agg(F.min_by("fault", "claim_id").alias("of_claim"))
    return goals.withColumn("own", own).join(first, "goal_id", "left").select("goal_id", F.coalesce("own", "of_claim").alias("reason")).where("reason IS NOT NULL")


def conflicts(goals: DataFrame, claims: DataFrame, days: int = 30) -> DataFrame:
    """(a, b, resources, confidence): pairs a < b of usable goals that want too much of the same resources, and of how many.

    ``days`` is the size of the cells of time that claims are filed under: about as long as a claim."""
    keys = ["snapshot", "run", "type", "resource_id", "unit"]
    usable = claims.join(goals.select("goal_id", "confidence"), "goal_id")
    # A claim goes along whole, as ids of claims may repeat; its goal comes first, so the order is that of goals.
    whole = F.struct("goal_id", "claim_id", "amount", "capacity", "confidence")
    met = relational.overlapping(usable.withColumn("claim", whole), keys, "claim", "start", "end", days)
    over = met.where("a.goal_id <> b.goal_id AND a.amount + b.amount > least(a.capacity, b.capacity)")
    rows = over.select(F.col("a.goal_id").alias("low"), F.col("b.goal_id").alias("high"), F.least("a.confidence", "b.confidence").alias("confidence"))
    return rows.groupBy(F.col("low").alias("a"), F.col("high").alias("b")).agg(F.count("*").alias("resources"), F.min("confidence").alias("confidence"))


def opportunities(goals: DataFrame, conflicting: DataFrame) -> DataFrame:
    """(snapshot, run, target, first, goals, domains, pairs, confidence): usable goals that share a target over several domains.

    pairs counts those of different domains that aren't conflicting(a, b)."""
    wanted = goals.withColumn("target", F.lower(F.trim("target"))).where("target <> ''")
    keys = ["snapshot", "run", "target"]
    per = wanted.groupBy(*keys, "domain").agg(F.count("*").alias("n"), F.min("goal_id").alias("first"), F.min("confidence").alias("confidence"))
    square = lambda c: c * c
    classes = per.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("n").alias("goals"), F.count("*").alias("domains"), F.sum(square(F.col("n"))).alias("squares"), F.min("confidence").alias("confidence"))
    side = lambda c: wanted.select(F.col("goal_id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in (*keys, "domain")])
    clashes = conflicting.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("snapshot_a = snapshot_b AND run_a = run_b AND target_a = target_b AND domain_a <> domain_b")
    lost = clashes.groupBy(*[F.col(f"{k}_a").alias(k) for k in keys]).agg(F.count("*").alias("lost"))
    pairs = ((square(F.col("goals")) - F.col("squares")) / 2).cast("long") - F.coalesce("lost", F.lit(0))
    return classes.where("domains > 1").join(lost, keys, "left").withColumn("pairs", pairs).where("pairs > 0").drop("squares", "lost")
