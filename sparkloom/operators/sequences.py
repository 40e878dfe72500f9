"""Runs of consecutive rows, and paths that end alike. No task holds a group: keys are (group, place) or suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import relational
from sparkloom.sources.shared import materialize


def consecutive(rows: DataFrame, group: str, place: str) -> DataFrame:
    """The rows whose predecessor, the same group's place less one, is there too. Rows are distinct."""
    before = rows.select(group, (F.col(place) + 1).alias(place))
    return rows.join(before, [group, place], "left_semi")


def runs(rows: DataFrame, group: str, place: str) -> DataFrame:
    """(group, start, length) of each longest run of consecutive places in a group. Rows are distinct.

    A run starts where no predecessor is there and ends where no successor is. Starts and ends, each numbered in the
    order of group and place over all groups at once, belong together number by number, so a group of any size is cut
    into ranges like any other rows."""
    rows = materialize(rows.select(group, place))
    after = rows.select(group, (F.col(place) - 1).alias(place))
    before = rows.select(group, (F.col(place) + 1).alias(place))
    all_ = F.lit(0).alias("all")
    starts = relational.ranked(rows.join(before, [group, place], "left_anti").select(all_, group, F.col(place).alias("start")), "all", group, "start")
    ends = relational.ranked(rows.join(after, [group, place], "left_anti").select(all_, F.col(group).alias("g"), F.col(place).alias("end")), "all", "g", "end")
    return starts.drop("all").join(ends.drop("all", "g"), "rank").select(group, "start", (F.col("end") - F.col("start") + 1).alias("length"))


def path_parts(path) -> F.Column:
    """The parts of a path, whichever way its slashes lean; empty and single-dot parts count for nothing."""
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", "."))


def _suffixes(rows: DataFrame, id_: str) -> DataFrame:
    """(id, n, suffix): each path's ends of n parts, as hashes chained from the last part on."""
    parts = F.reverse(path_parts(F.col("path")))
    chained = F.aggregate(parts, F.array(F.lit("")), lambda acc, p: F.array_append(acc, F.sha2(F.concat_ws("/", F.element_at(acc, -1), p), 256)))
    return rows.select(id_, F.posexplode(chained).alias("n", "suffix")).where("n > 0")


def longest_suffix(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right, n, ties) for left(left, path) with right(right, path): the path that shares the most parts at its end.

    Of several that share as many, the smallest is taken and ties tells how many there are. Left paths without a shared
    part have no row. Right paths are folded to one row a suffix first, so names that all paths end in join once."""
    ends = _suffixes(right, "right").groupBy("n", "suffix").agg(F.min("right").alias("right"), F.countDistinct("right").alias("ties"))
    met = _suffixes(left, "left").join(ends, ["n", "suffix"])
    best = met.groupBy("left").agg(F.max(F.struct("n", "right", "ties")).alias("b"))
    return best.select("left", "b.right", "b.n", "b.ties")
