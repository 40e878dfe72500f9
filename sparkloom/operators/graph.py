"""Graph operators on edge tables; every step is written to the shared folder, so a lost executor costs one step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import materialize

#: Members of a node's list that one cell of ``common_neighbours`` holds at most, on average; pairs that a task counts.
BLOCK, TASK_PAIRS = 256, 4_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """edges(a, b) both ways, without loops and repeats."""
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) with the smallest id reachable, by hash-min with pointer jumping: few rounds even on paths."""
    both = materialize(undirected(edges))
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        better = labels.join(seen, labels["id"] == seen["a"], "left").select("id", F.least("component", "m").alias("component"))
        jump = better.join(better.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
        following = materialize(jump.select("id", F.least("component", F.coalesce("root", "component")).alias("component")))
        changed = following.join(labels, ["id", "component"], "left_anti").isEmpty()
        labels = following
        if changed:
            return labels


def hops(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(id, depth) of the nodes within ``most`` hops of seeds(id), level by level."""
    both = materialize(undirected(edges))
    seen = frontier = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    for depth in range(1, most + 1):
        reached = both.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = materialize(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def common_neighbours(edges: DataFrame, most_degree: int | None = None) -> DataFrame:
    """(x, y, n): pairs of ``a`` nodes and the number of ``b`` nodes that both are joined to.

    The list of a ``b`` node is cut into blocks, which each of its members meets one by one, so a node of any degree
    is compared whole but never by one task. Partners travel to the counting as lists, to as many tasks as there are
    pairs for. The pairs themselves grow with the square of a degree."""
    rows = edges.select("a", "b").distinct()
    if most_degree is not None:
        rows = rows.join(rows.groupBy("b").agg(F.count("*").alias("d")).where(F.col("d") <= most_degree).select("b"), "b")
    degrees = rows.groupBy("b").agg(F.count("*").alias("d")).where("d > 1")
    cut = materialize(rows.join(degrees, "b").withColumn("blocks", F.ceil(F.col("d") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")))
    pairs = cut.agg(F.sum("d")).first()[0] or 0
    tasks = max(1, -(-pairs // (2 * TASK_PAIRS)))
    lists = cut.withColumn("i", F.col("own")).repartition(tasks, "b", "i").groupBy("b", "i").agg(F.array_sort(F.collect_list("a")).alias("ys"))
    asking = cut.select("b", F.col("a").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).repartition(tasks, "b", "i")
    partners = asking.join(lists, ["b", "i"]).select("x", F.filter("ys", lambda y: y > F.col("x")).alias("ys")).where(F.size("ys") > 0)
    met = partners.repartition(tasks, "x").select("x", F.explode("ys").alias("y"))
    return met.groupBy("x", "y").agg(F.count("*").alias("n"))


def shortest_paths(edges: DataFrame, source: str, most: int) -> DataFrame:
    """(id, depth, previous) of the nodes within ``most`` steps of a node, level by level; of several previous nodes the smallest."""
    both = materialize(undirected(edges))
    spark = edges.sparkSession
    kind = both.schema["a"].dataType
    seen = frontier = spark.range(1).select(F.lit(source).cast(kind).alias("id"), F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("previous"))
    for depth in range(1, most + 1):
        reached = both.join(frontier.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("previous"))
        frontier = materialize(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "previous"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
