"""Canonical units: groups of like units of one bucket, reduced to one each, and the gate that judges the grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import identity
from sparkloom.operators.leaders import leader_clusters

#: Lifecycles from the mildest to the gravest; a merged unit has its members' gravest.
SEVERITY = ("current", "deprecated", "superseded", "conflict")


def bucket(subject: Column, kind: Column, scope: Column, lifecycle: Column) -> Column:
    """Units are only ever merged with others of their subject, kind and scope, and conflicts with conflicts."""
    temporal = F.when(lifecycle == "conflict", "conflict").otherwise("normal")
    return F.concat_ws("|", F.lower(F.trim(subject)), kind, F.coalesce(scope, F.lit("user")), temporal)


def members(units: DataFrame, percent: int = 85) -> DataFrame:
    """(id, leader) of units(id, subject, kind, scope, lifecycle, question, answer): like questions and answers, in order."""
    said = F.lower(F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))))
    bare = F.regexp_replace(said, r"[ \t\n\x0b\f\r]+", "")
    rows = units.select("id", bucket(F.col("subject"), F.col("kind"), F.col("scope"), F.col("lifecycle")).alias("bucket"), bare.alias("members"))
    return leader_clusters(rows, percent)


def canonical_units(units: DataFrame, membership: DataFrame) -> DataFrame:
    """One row a group: the longest answer's unit (the first of equally long ones), the least confidence, the gravest lifecycle.

    Members stay in ``membership``; here they are counted, so a group of any size is a few partial aggregates."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("lifecycle"))
    named = units.select("id", "confidence", rank.alias("rank"), F.char_length("answer").alias("length"), identity.canonical_id(F.col("subject"), F.col("kind"), F.col("answer")).alias("name"))
    best = F.max_by(F.struct("id", "name"), F.struct("length", -F.col("id"))).alias("best")  # texts are not sent
    grouped = named.join(membership, "id").groupBy("leader").agg(best, F.min("confidence").alias("confidence"), F.max("rank").alias("rank"), F.count("*").alias("n_members"))
    lifecycle = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("rank").cast("int"))
    reason = F.when(F.col("n_members") > 1, "similar_merge").otherwise("single")
    return grouped.select("leader", F.col("best.name").alias("canonical_unit"), F.col("best.id").alias("best"), "confidence", lifecycle.alias("lifecycle"), "n_members", reason.alias("merge_reason"))


def merge_gate(membership: DataFrame, evidence: DataFrame, positives: DataFrame, negatives: DataFrame, least_recall: float = 0.8) -> DataFrame:
    """One row that says whether pairs(a, b) of references that should be merged are, and no pair that shouldn't.

    evidence(ref, id) names the units of a reference; a pair counts as merged if any of its units are, and is left out
    of the figures, but counted, if either reference has no unit. Without a pair that counts there is no verdict."""
    side = lambda c: evidence.join(membership, "id").select(F.col("ref").alias(c), "leader")
    refs = evidence.join(membership.select("id"), "id").select("ref").distinct()

    def judged(pairs: DataFrame, wanted: bool) -> DataFrame:
        pairs = pairs.select("a", "b").distinct()
        same = pairs.join(side("a"), "a").join(side("b"), ["b", "leader"]).select("a", "b").distinct().withColumn("merged", F.lit(True))
        there = pairs.join(refs.withColumnRenamed("ref", "a"), "a", "left_semi").join(refs.withColumnRenamed("ref", "b"), "b", "left_semi").withColumn("known", F.lit(True))
        return pairs.join(there, ["a", "b"], "left").join(same, ["a", "b"], "left").select(F.lit(wanted).alias("wanted"),
            F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("merged", F.lit(False)).alias("merged"))

    rows = judged(positives, True).unionByName(judged(negatives, False))
    count = lambda c: F.count_if(c).cast("long")
    figures = rows.agg(
        count(F.col("wanted") & F.col("known")).alias("positives"), count(F.col("wanted") & F.col("merged")).alias("merged_positives"),
        count(~F.col("wanted") & F.col("known")).alias("negatives"), count(~F.col("wanted") & F.col("merged")).alias("false_merges"), count(~F.col("known")).alias("unresolved"),
    )
    recall = F.round(F.col("merged_positives") / F.nullif(F.col("positives"), F.lit(0)), 6)
    verdict = F.when(F.col("positives") == 0, "not_applicable").when((recall >= least_recall) & (F.col("false_merges") == 0), "passed").otherwise("failed")
    return figures.withColumn("recall", recall).withColumn("verdict", verdict)
