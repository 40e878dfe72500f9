"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Rows are dealt into blocks; in a block every dimension has a list of the rows sorted by that component. An anchor reads
the lists in step, from the top where its own component is positive and from the bottom where it is negative, scores
each row it meets for the first time by an integer inner product with the whole row (random access), and knows that no
unmet row scores above the threshold: the inner product with the values it has read last. It stops once the threshold
is strictly below the k-th score of every window it serves (or below the window's lower end). Reads come in batches
that double, so a stop is at most a batch late. What the blocks find is merged, which is exact.

Positives come from the blocks of the anchor's label by the same walk, with one window that has no bounds. Anchors meet
all blocks (a stated query set against all rows); a block whose first threshold is below all windows is left at once.

Defined cases: rows without an id or a label, or whose vector is null, empty, holds null or non-finite entries or has
another length than most take no part, nor do rows with a component too large for any inner product to fit a long;
of rows that share an id, the one with the least label, then the least vector counts; equal scores go to the smaller
id; an anchor without positives, or a window without rows, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import vectors
from sparkloom.llm.common import materialize

#: Anchors of a block; entries that the first batch reads from each list.
ANCHOR_BLOCK, FIRST_READ = 128, 8


class SortedLists:
    """A block of integer vectors with every dimension's rows in falling order of that component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        # Inner products are exact in doubles while they stay below 2**53; else longs are used, which BLAS doesn't know.
        limit = math.isqrt((1 << 53) // max(1, x.shape[1]))
        self.ids, self.x = ids, x.astype(np.float64) if np.abs(x).max(initial=0) < limit else x
        self.order = np.argsort(-x, axis=0, kind="stable")

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Batches of (rows met, their scores, bound on all rows not met yet); the first has no rows, the last no bound."""
        whole = np.abs(anchor).max(initial=0) < 2**26 and self.x.dtype == np.float64
        a, x = (anchor.astype(np.float64), self.x) if whole else (anchor.astype(np.int64), self.x.astype(np.int64))
        n, (up, down) = len(self.ids), (np.flatnonzero(a > 0), np.flatnonzero(a < 0))
        bound = lambda i: x[self.order[i, up], up] @ a[up] + x[self.order[n - 1 - i, down], down] @ a[down]
        none = np.zeros(0, dtype=np.int64)
        yield none, none, bound(0)
        met, depth, step = np.zeros(n, dtype=bool), 0, FIRST_READ
        while depth < n:
            to = min(n, depth + step) if len(up) + len(down) else n
            read = np.zeros(n, dtype=bool)
            read[self.order[depth:to][:, up]] = True
            read[self.order[n - to : n - depth][:, down]] = True
            new = np.flatnonzero(read & ~met) if len(up) + len(down) else np.arange(n)
            met[new] = True
            yield new, (x[new] @ a).astype(np.int64), bound(to - 1) if to < n else -math.inf
            depth, step = to, 2 * step


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _best_of(lists: SortedLists, anchor: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best allowed rows."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for new, got, bound in lists.walk(anchor):
        ok = allowed[new]
        ids, scores = np.concatenate([ids, lists.ids[new[ok]]]), np.concatenate([scores, got[ok]])
        first = _first(scores, ids, k)
        ids, scores = ids[first], scores[first]
        if len(ids) == k and bound < scores[-1]:
            break
    return ids, scores


def _in_windows(lists: SortedLists, anchor: np.ndarray, allowed: np.ndarray, windows: np.ndarray, low: int, high: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window, ids and scores of its k best allowed rows: low * p <= 100 * score <= high * p."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    tops, bottoms = np.array([high * int(p) // 100 for p in windows]), np.array([-(-low * int(p) // 100) for p in windows])
    open_ = bottoms <= tops
    for new, got, bound in lists.walk(anchor):
        new, got = new[allowed[new]], got[allowed[new]]
        for w in np.flatnonzero(open_):
            inside = (got >= bottoms[w]) & (got <= tops[w])
            if inside.any():
                ids, scores = np.concatenate([found[w][0], lists.ids[new[inside]]]), np.concatenate([found[w][1], got[inside]])
                first = _first(scores, ids, k)
                found[w] = ids[first], scores[first]
            open_[w] = bound >= (found[w][1][-1] if len(found[w][1]) == k else bottoms[w])
        if not open_.any():
            break
    return found


def _long(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def positives(rows: DataFrame, anchors: DataFrame, k: int, per_block: int) -> DataFrame:
    """(query, positive_id, positive_score): the k best other rows of each anchor's label."""

    def best(key, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        names, others, scores = [], [], []
        if rows.num_rows and anchors.num_rows:
            lists = SortedLists(rows["id"].to_numpy(), vectors.matrix(rows["x"], np.int64))
            for name, anchor in zip(anchors["query"].to_numpy(), vectors.matrix(anchors["q"], np.int64), strict=True):
                ids, got = _best_of(lists, anchor, lists.ids != name, k)
                names.append(np.full(len(ids), name))
                others.append(ids)
                scores.append(got)
        return pa.table({"query": _long(names), "positive_id": _long(others), "positive_score": _long(scores)})

    groups = vectors.keyed_blocks(rows, anchors, ["label"], per_block, ANCHOR_BLOCK)
    found = groups.applyInArrow(best, "query long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("positive_score"), "positive_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def hard_negatives(rows: DataFrame, anchors: DataFrame, k: int = 3, n_positives: int = 5, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(id, label, x) and anchors, some of them.

    A negative has another label, and its score lies between low and high percent of the positive's."""
    size = rows.select(F.size("x")).head(1)
    per_block = vectors.block_rows(size[0][0] if size else 1)
    queries = anchors.select(F.col("id").alias("query"), "label", F.col("x").alias("q"))
    chosen = positives(rows, queries, n_positives, per_block)
    pairs = F.collect_list(F.struct("positive_id", "positive_score")).alias("pairs")  # n_positives at most
    asked = materialize(queries.join(chosen.groupBy("query").agg(pairs), "query"))

    def best(key, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}
        if rows.num_rows and anchors.num_rows:
            lists, labels = SortedLists(rows["id"].to_numpy(), vectors.matrix(rows["x"], np.int64)), rows["label"].to_numpy()
            for name, label, anchor, pairs in zip(anchors["query"].to_numpy(), anchors["label"].to_numpy(), vectors.matrix(anchors["q"], np.int64), anchors["pairs"].to_pylist(), strict=True):
                found = _in_windows(lists, anchor, labels != label, np.array([p["positive_score"] for p in pairs]), low, high, k)
                for p, (ids, scores) in zip(pairs, found, strict=True):
                    for c, x in zip(out, (name, p["positive_id"], p["positive_score"]), strict=False):
                        out[c].append(np.full(len(ids), x))
                    out["negative_id"].append(ids)
                    out["negative_score"].append(scores)
        return pa.table({c: _long(parts) for c, parts in out.items()})

    blocks = lambda table, per: F.lit(max(1, -(-table.count() // per)))
    dealt = blocks(rows, per_block), blocks(asked, ANCHOR_BLOCK)
    groups = vectors.in_blocks(rows, dealt, asked, dealt, [])
    found = groups.applyInArrow(best, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled_rows(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, x): the rows that take part, each component scaled and rounded down."""
    rows = vectors.usable(embeddings.where(F.col(label).isNotNull()), vector)
    most = math.isqrt(((1 << 63) - 1) // max(1, vectors.length(rows)))
    rows = rows.select(F.col("row")[id].cast("long").alias("id"), F.col("row")[label].cast("long").alias("label"), F.transform("v", lambda c: F.floor(scale * c)).alias("x"))
    rows = rows.where(F.forall("x", lambda c: c.between(-most, most)))
    return vectors.one_per_id(rows, "label", "x")
