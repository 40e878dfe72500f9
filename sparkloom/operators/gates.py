"""Verdicts over rows of facts: canary gates, the quality of extracted units, and risks read off trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import sealing

# The labels a result can have, and the thresholds of the canary gate.
LABELS = ("helpful", "wrong", "stale", "missing")
LEAST_HELPFUL, MOST_FALLBACK, MOST_LATENCY = 0.8, 0.3, 500.0
# What each risk rule looks for in a trend, and the confidence below which its support is weak.
RISKS = {"increasing_constraint_pressure": ("constraint", "up"), "decreasing_goal_signal": ("goal", "down")}
WEAK = 0.6


def canary_gates(results: DataFrame, by: str) -> DataFrame:
    """One verdict for each value of ``by`` over results(by, label, route, latency).

    Any unlabelled result makes it wait. The 95th percentile is the value at the floor of its index, found from counts
    of equal latencies, so no group is ever held whole; it is null where no latency is known, which fails the gate."""
    share = lambda n: F.round(n / F.col("total"), 4)
    count = lambda c: F.count_if(c).cast("long")
    label = F.coalesce("label", F.lit(""))
    sums = results.groupBy(by).agg(
        F.count("*").alias("total"), *[count(label == name).alias(name) for name in LABELS], count(~label.isin(*LABELS)).alias("unlabelled"),
        count(F.contains(F.coalesce("route", F.lit("")), F.lit("fallback"))).alias("fallback"),
    )
    latencies = results.where("latency IS NOT NULL").groupBy(by, "latency").agg(F.count("*").alias("n"))
    p95 = _at_index(latencies, by, "latency", 95).withColumnRenamed("at", "p95")
    rows = sums.join(p95, by, "left").withColumn("helpful_rate", share(F.col("helpful"))).withColumn("fallback_rate", share(F.col("fallback")))
    passed = (F.col("helpful") / F.col("total") >= LEAST_HELPFUL) & (F.col("wrong") + F.col("stale") == 0) & (F.col("fallback") / F.col("total") <= MOST_FALLBACK) & F.coalesce(F.col("p95") <= MOST_LATENCY, F.lit(False))
    return rows.withColumn("status", F.when(F.col("unlabelled") > 0, "awaiting_labels").when(passed, "PASS").otherwise("FAIL"))


def _at_index(counts: DataFrame, by: str, value: str, percent: int) -> DataFrame:
    """(by, at): the value at index floor(n * percent / 100) of the sorted values that counts(by, value, n) stands for.

    A window runs over distinct values only."""
    ordered = Window.partitionBy(by).orderBy(value)
    rows = counts.withColumn("upto", F.sum("n").over(ordered)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    index = F.floor(F.col("all") * percent / 100)
    return rows.where((F.col("upto") > index) & (F.col("upto") - F.col("n") <= index)).select(by, F.col(value).alias("at"))


def extraction_quality(units: DataFrame, by: str) -> DataFrame:
    """Of units(by, unit_type, subject, question, answer, evidence): how many have evidence and all required fields, repeat
    one before them, or let credentials or personal data through. Every unit is looked at."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    said = F.concat_ws(" ", "subject", "question", "answer", "evidence")
    key = F.sha2(F.concat_ws("|", F.coalesce("unit_type", F.lit("")), F.lower(F.trim(F.coalesce("subject", F.lit("")))), F.substring(F.lower(F.trim(F.coalesce("answer", F.lit("")))), 1, 120)), 256)
    rows = units.select(by, key.alias("key"), filled(F.col("evidence")).alias("evidence"),
        (filled(F.col("unit_type")) & filled(F.col("subject")) & filled(F.col("answer"))).alias("complete"), (F.size(sealing.sealed_text(said)["kinds"]) > 0).alias("leaks"))
    count = lambda c: F.count_if(c).cast("long")
    per = rows.groupBy(by, "key").agg(F.count("*").alias("n"), count(F.col("evidence")).alias("evidence"), count(F.col("complete")).alias("complete"), count(F.col("leaks")).alias("leaks"))
    out = per.groupBy(by).agg(F.sum("n").alias("units"), F.sum("evidence").alias("with_evidence"), F.sum("complete").alias("complete"),
        (F.sum("n") - F.count("*")).alias("repeats"), F.sum("leaks").alias("leaks"))
    ratio = lambda c: F.round(F.col(c) / F.col("units"), 4).alias(f"{c}_rate")
    return out.select("*", *[ratio(c) for c in ("with_evidence", "complete", "repeats", "leaks")])


def risk(trends: DataFrame, rule: str, least_samples: int = 3) -> DataFrame:
    """trends(kind, direction, status, samples, evidence, confidence, ...) with risk_status, severity, risk_confidence and the
    reasons for which a risk is uncertain, in order of their names. A null counts as what speaks against the risk."""
    kind, direction = RISKS[rule]
    no = lambda c: F.coalesce(c, F.lit(True))
    reasons: dict[str, Column] = {
        "evidence_ineligible": no(F.col("evidence") < 1),
        "insufficient_samples": no(F.col("samples") < least_samples),
        "rule_not_matched": no((F.col("kind") != kind) | (F.col("direction") != direction)),
        "upstream_trend_uncertain": no(F.col("status") != "derived"),
        "weak_support": no(F.col("confidence") < WEAK),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in sorted(reasons.items())])).cast("array<string>")
    rows = trends.withColumn("reasons", found)
    sure = F.size("reasons") == 0
    return rows.select("*", F.when(sure, "derived").otherwise("uncertain").alias("risk_status"), F.when(sure, "medium").alias("severity"),
        F.when(sure, F.col("confidence")).otherwise(0.0).alias("risk_confidence"))
