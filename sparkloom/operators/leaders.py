"""Greedy leader clusters of similar sets, in the order of their ids, without comparing all pairs.

Going through a bucket by id, a row leads a cluster of its own unless a leader before it is similar, and joins the
first such leader. Components are not that: a row may be like a member and not like its leader.

Rows of equal sets share a fate, so the first stands for all. Sketches of the sets tell which may be alike (see
``likeness``), and only sets of such pairs are ever sent, so:
1. a row that nothing open before it may be like surely leads; what is like it is settled. A few such rounds settle
   groups of near copies, however large, with pairs that are linear in the rows;
2. the rows that are left are linked, and in rounds every row without an unsettled row linked before it leads, and what
   it is linked to is settled. Chains that are still open after LINK_ROUNDS rounds are walked in order, each component
   by itself;
3. all others join the first leader that is like them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graph, likeness
from sparkloom.sources.shared import materialize

#: Rounds over certain leaders; rounds over links before chains are walked.
STAR_ROUNDS, LINK_ROUNDS = 3, 6


def _walk(links: DataFrame) -> DataFrame:
    """(id) of the leaders among links(a, b), a < b: components one by one, their links in order."""
    named = graph.components(links).withColumnRenamed("id", "b")
    from_ = named.select(F.col("b").alias("a"), F.lit(None).cast("long").alias("before"), "component")
    rows = links.join(named, "b").select(F.col("b").alias("a"), F.col("a").alias("before"), "component").unionByName(from_)

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In the order of component, row and earlier row; a row's own entry, without an earlier one, comes first."""
        component, row, leaders, blocked, out = None, None, set(), False, []
        for batch in batches:
            for c, a, before in zip(*[batch.column(n).to_pylist() for n in ("component", "a", "before")], strict=True):
                if a != row:
                    if row is not None and not blocked:
                        leaders.add(row)
                        out.append(row)
                    if c != component:
                        leaders = set()
                    component, row, blocked = c, a, False
                blocked = blocked or before in leaders
            yield pa.RecordBatch.from_pydict({"id": pa.array(out, pa.int64())})
            out = []
        if row is not None and not blocked:
            yield pa.RecordBatch.from_pydict({"id": pa.array([row], pa.int64())})

    ordered = rows.repartition("component").sortWithinPartitions("component", "a", F.col("before").asc_nulls_first())
    return ordered.select("component", "a", "before").mapInArrow(led, "id long")


def _by_links(open_: DataFrame, links: DataFrame) -> DataFrame:
    """(id) of the leaders among the open rows, which links(a, b), a < b, join."""
    found = []
    for _ in range(LINK_ROUNDS):
        linked = links.select(F.col("b").alias("id")).distinct()
        lead = materialize(open_.join(linked, "id", "left_anti").select("id"))
        found.append(lead)
        covered = links.join(lead.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        open_ = materialize(open_.join(lead, "id", "left_anti").join(covered, "id", "left_anti").select("id"))
        if open_.isEmpty():
            break
        still = lambda c: open_.withColumnRenamed("id", c)  # noqa: B023, E731
        links = materialize(links.join(still("a"), "a", "left_semi").join(still("b"), "b", "left_semi"))
    else:
        found.append(materialize(_walk(links)))
        alone = open_.join(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_anti")
        found.append(alone.select("id"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _kinds(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their members, not written; rows with a name for their set; the first row of each set of a bucket, with its sketch."""
    members = likeness.hashed(F.col("members"), dict(rows.dtypes)["members"])
    rows = rows.where("id IS NOT NULL").select("id", F.coalesce(F.col("bucket").cast("string"), F.lit("\0")).alias("bucket"), members.alias("members"))
    kinds = materialize(likeness.sketched(rows, percent))
    firsts = kinds.where("n > 0").groupBy("bucket", "kind").agg(F.min("id").alias("id"))
    return rows, kinds.select("id", "bucket", "kind"), materialize(kinds.join(firsts, ["bucket", "kind", "id"]))


def similar_links(rows: DataFrame, percent: int = 85) -> DataFrame:
    """(a, b), a < b, whose components are those of all like rows of rows(id, bucket, members): every pair of like sets
    once, by the first row of each, and each row of a set with that first row."""
    rows, kinds, sets = _kinds(rows, percent)
    apart = likeness.confirmed(likeness.candidates(*likeness.placed(sets, percent), percent), rows, percent).select("a", "b")
    same = kinds.join(sets.select("bucket", "kind", F.col("id").alias("first")), ["bucket", "kind"]).where("first < id").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return apart.unionByName(same)


def leader_clusters(rows: DataFrame, percent: int = 85) -> DataFrame:
    """(id, leader) of rows(id long, bucket, members): the leader each row belongs to, itself if it leads.

    members is a list of strings or of their hashes, or a string whose windows of four characters they are. Two sets are
    alike from a Jaccard similarity of percent / 100 on; an empty or null set is like nothing. Ids are unique; their
    order is the order of the rows; rows without an id take no part; a null bucket is one of its own."""
    rows, kinds, sets = _kinds(rows, percent)
    cut, cells = likeness.placed(sets, percent)
    dealt = lambda among, lead: among.join(lead.withColumn("role", F.lit(1)), "id", "left").withColumn("role", F.coalesce("role", F.lit(2)))
    open_, leaders, met, alike = cut, [], [], []
    for _ in range(STAR_ROUNDS):
        lead = materialize(open_.select("id").join(likeness.behind(open_, cells, percent), "id", "left_anti"))
        leaders.append(lead)
        met.append(materialize(likeness.between(dealt(open_, lead), cells, percent)))
        alike.append(materialize(likeness.confirmed(met[-1], rows, percent).select("a", "b")))
        settled = lead.unionByName(alike[-1].select(F.col("b").alias("id")))
        open_ = materialize(open_.join(settled, "id", "left_anti"))
        if open_.isEmpty():
            break
    else:
        links = materialize(likeness.confirmed(likeness.candidates(open_, cells, percent), rows, percent).select("a", "b"))
        leaders.append(_by_links(open_.select("id"), links))
    led = leaders[0]
    for more in leaders[1:]:
        led = led.unionByName(more)
    led = materialize(led)

    rest = likeness.between(dealt(cut, led), cells, percent)
    for done in met:  # judged before
        rest = rest.join(done, ["a", "b"], "left_anti")
    joined = likeness.confirmed(rest, rows, percent).select("a", "b")
    for more in alike:
        joined = joined.unionByName(more)
    joined = joined.groupBy("b").agg(F.min("a").alias("leader"))
    named = sets.select("id", "bucket", "kind").join(joined.withColumnRenamed("b", "id"), "id", "left").select("bucket", "kind", F.coalesce("leader", "id").alias("leader"))
    return kinds.join(named, ["bucket", "kind"], "left").select("id", F.coalesce("leader", "id").alias("leader"))
