"""Layered retrieval: layers in order, each only as far as the ones before leave room, with the evidence behind each hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import tokens
from sparkloom.operators import vectors

# The layers in the order they are asked, and how many hits each fetches beyond the open places.
LAYERS = {"knowledge": 3, "canonical_messages": 4, "conversation_turns": 4, "non_dialogue_raw": 4, "legacy_pad": 8}
# States in which a unit gives no answer.
BLOCKED_LIFECYCLES = ("deprecated", "superseded", "conflict", "retracted", "deleted")
BLOCKED_PRIVACY = ("secret", "blocked", "excluded", "system", "private_secret")


def layered(items: DataFrame, queries: DataFrame, k: int, bound: bool, roles: tuple[str, ...]) -> DataFrame:
    """(query, layer, id, score, place): the k hits of queries(query, v) over items(id, v, layer, unit).

    A layer is asked when the ones before have left places open. Hits of one unit count once, in the first layer that
    has them. With a bound snapshot the legacy layer is skipped, and so is every layer whose role the snapshot lacks."""
    asked = [n for n in LAYERS if not skip_reason(n, bound, roles)]
    found = None
    for rank, name in enumerate(asked):
        part = items.where(F.col("layer") == name)
        hits = vectors.top_k(part.select("id", "v"), queries, k + LAYERS[name]).join(part.select("id", "unit"), "id")
        hits = hits.select("query", F.lit(rank).alias("layer_rank"), F.lit(name).alias("layer"), "id", "unit", "score", "rank")
        found = hits if found is None else found.unionByName(hits)
    once = found.withColumn("n", F.row_number().over(Window.partitionBy("query", "unit").orderBy("layer_rank", "rank"))).where("n = 1").drop("n")
    place = F.row_number().over(Window.partitionBy("query").orderBy("layer_rank", "rank"))
    return once.withColumn("place", place).where(F.col("place") <= k).select("query", "layer", "id", "unit", "score", "place")


def skip_reason(layer: str, bound: bool, roles: tuple[str, ...]) -> str | None:
    if layer == "legacy_pad":
        return "not_bound_to_serving_snapshot" if bound else None
    return f"snapshot_member_missing:{layer}" if bound and layer not in roles else None


def telemetry(hits: DataFrame, queries: DataFrame, k: int, bound: bool, roles: tuple[str, ...]) -> DataFrame:
    """(query, layer, skipped, returned, open): what each layer gave, and how many places were open before it."""
    spark = hits.sparkSession
    rows = [(n, i, skip_reason(n, bound, roles)) for i, n in enumerate(LAYERS)]
    plan = F.broadcast(spark.createDataFrame(rows, "layer string, layer_rank int, skipped string"))  # one row a layer
    given = hits.groupBy("query", "layer").agg(F.count("*").alias("returned"))
    every = queries.select("query").join(plan).join(given, ["query", "layer"], "left").withColumn("returned", F.coalesce("returned", F.lit(0)))
    before = F.coalesce(F.sum("returned").over(Window.partitionBy("query").orderBy("layer_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return every.withColumn("open", F.greatest(k - before, F.lit(0)))


def rank_key(score: Column, turn: Column, unit: Column, title: Column) -> Column:
    """Hits of several collections in one order: score, then turns, then turn units, then the longer title."""
    return F.struct(score, turn.cast("int"), unit.cast("int"), F.char_length(F.trim(F.coalesce(title, F.lit("")))))


def support(query: Column, text: Column, lifecycle: Column, privacy: Column, status: Column) -> Column:
    """struct(state, reason) of an answer's evidence: status is that of its reference, or null without one."""
    overlap = F.arrays_overlap(tokens.retrieval_tokens(query), tokens.retrieval_tokens(text))
    return verdict(overlap, literal_absent(tokens.required_literals(query), text), lifecycle, privacy, status)


def literal_absent(literals: Column, text: Column) -> Column:
    return F.exists(literals, lambda x: ~F.contains(text, x))


def verdict(overlap: Column, absent: Column, lifecycle: Column, privacy: Column, status: Column) -> Column:
    """support() of a hit whose texts were compared before: whether they share a token, and whether a required literal is absent."""
    says = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    return (
        F.when(F.lower(lifecycle).isin(*BLOCKED_LIFECYCLES), says("unsupported", "lifecycle_not_current"))
        .when(F.lower(privacy).isin(*BLOCKED_PRIVACY), says("unsupported", "privacy_or_provenance_veto"))
        .when(absent, says("unsupported", "required_literal_absent"))
        .when(status.isin("ineligible", "blocked", "secret"), says("unsupported", "evidence_ineligible"))
        .when(status.isin("missing", "unknown_type", "unknown"), says("unsupported", "evidence_missing"))
        .when((status == "ok") & overlap, says("supported", "eligible_evidence,query_candidate_grounded"))
        .when(status == "ok", says("unsupported", "query_candidate_ungrounded"))
        .when(~overlap, says("uncertain", "evidence_reference_absent,query_candidate_ungrounded"))
        .otherwise(says("uncertain", "evidence_reference_absent"))
    )


def paired_bootstrap(pairs: DataFrame, draws: int = 10_000) -> DataFrame:
    """n, the mean of the differences of pairs(i, d) with i from 0 to n - 1, and the bounds of 95 % of resampled means.

    Draw b takes n pairs with replacement, the j-th by a hash of b and j, so that another engine draws alike. Draws are
    dealt over tasks; a pair list is one evaluation set and its size is checked before it is broadcast."""
    total = pairs.agg(F.count("*").alias("n"), F.sum("d").alias("s")).first()
    n = total["n"]
    spark = pairs.sparkSession
    if not n:
        return spark.createDataFrame([], "n long, mean double, low double, high double")
    small = F.broadcast(pairs) if n <= 1_000_000 else pairs
    cells = spark.range(draws * n).select(F.expr(f"id DIV {n}").alias("b"), (F.col("id") % n).alias("j"))  # a sequence of n would be a constant in the plan
    index = F.conv(F.substring(F.md5(F.concat_ws("|", "b", "j")), 1, 8), 16, 10).cast("long") % n
    means = cells.withColumn("i", index).join(small, "i").groupBy("b").agg(F.round(F.sum("d") / n, 9).alias("m"))
    counted = means.groupBy("m").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda p: F.min(F.when(F.col("upto") > int(draws * p), F.col("m")))
    return counted.agg(at(0.025).alias("low"), at(0.975).alias("high")).select(F.lit(n).cast("long").alias("n"),
        F.round(F.lit(total["s"] / n), 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
