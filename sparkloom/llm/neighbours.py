"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact distances.

Each of TABLES tables cuts Gaussian projections (2-stable: a distance r between vectors becomes a deviation r between
projections) into slots; the slots of a vector are its bucket. A query estimates for each function how likely a
neighbour at distance r lies in each slot, and visits the buckets of a table by falling product of these, its own one
first, until the tables together hold such a neighbour with probability SUCCESS. Candidates of all tables are merged
and ranked by their exact distances.

r bounds the distance of the k-th neighbour from above: it is that of the 2k-th nearest row of a bounded sample. The
sample fits radius, slot width and number of functions only; every row is indexed, and results come from buckets. A
query that finds fewer than k rows within r visits all buckets, so none has fewer than k while there are k others.

Defined cases: rows without an id, or whose vector is null, empty, zero, holds null or non-finite entries or has another
length than most take no part; of rows that share an id, the one with the least vector counts; equal distances go to
the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import vectors
from sparkloom.llm.common import materialize, mix

SEED = 12
TABLES = 8
#: Probability that the buckets visited hold a neighbour at distance r.
SUCCESS = 0.97
#: Width of a slot as a multiple of the sample's median r; rows in the bucket of a row, on average.
WIDTH, BUCKET_ROWS = 3.0, 256
#: Rows that share a group of buckets, on average; queries of a block. A larger group is dealt over several tasks.
CELL_ROWS, QUERY_BLOCK = 4096, 1024
#: Functions of a table at most. Each doubles the buckets that a query visits; with fewer, buckets are larger.
MOST_FUNCTIONS = 16
#: Queries whose buckets one task finds.
ASKED_TOGETHER = 64


@dataclass
class Index:
    """What a bounded sample fits: hash functions, slot width, and the sample itself, for the radii of queries."""

    sample: np.ndarray
    directions: np.ndarray  # (tables, size, functions)
    shifts: np.ndarray  # (tables, functions)
    multipliers: np.ndarray  # (tables, functions)
    width: float
    cells: int

    def projected(self, v: np.ndarray) -> np.ndarray:
        """In slots: (tables, rows, functions)."""
        return np.stack([v @ a / self.width + b for a, b in zip(self.directions, self.shifts, strict=True)])

    def bucket(self, table: int, slots: np.ndarray) -> np.ndarray:
        return mix((slots.astype(np.int64).astype(np.uint64) * self.multipliers[table]).sum(axis=-1, dtype=np.uint64))


def radius(sample: np.ndarray, q: np.ndarray, k: int) -> float:
    """The distance of q's 2k-th nearest row of the sample, of which q itself may be one."""
    if not len(sample):
        return 0.0
    d = ((sample - q) ** 2).sum(axis=1)
    at = min(2 * k, len(d) - 1)
    return math.sqrt(np.partition(d, at)[at])


def fit(rows: DataFrame, k: int) -> Index | None:
    """From rows(id, v): the sample is the rows with the least hashes of their ids, as many as BLOCK_VALUES values allow."""
    n = rows.count()
    if not n:
        return None
    size = vectors.length(rows)
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(vectors.block_rows(size)).select("v").toPandas()["v"]
    sample = np.array(taken.tolist(), dtype=np.float64)
    rng = np.random.default_rng(SEED)
    some = sample[: 256]
    radii = [r for r in (radius(sample, q, k) for q in some) if r > 0]
    width = WIDTH * (float(np.median(radii)) if radii else 1.0)
    directions = rng.standard_normal((TABLES, size, MOST_FUNCTIONS))
    shifts = rng.random((TABLES, MOST_FUNCTIONS))
    multipliers = rng.integers(0, 1 << 63, (TABLES, MOST_FUNCTIONS)).astype(np.uint64) | np.uint64(1)
    # How often two rows share a slot tells how many functions leave BUCKET_ROWS in a bucket.
    slots = np.floor(np.concatenate(list(some @ directions / width + shifts[:, None]), axis=1))
    pairs = max(1, len(some) * (len(some) - 1))
    shared = float(np.mean([((np.unique(c, return_counts=True)[1] ** 2).sum() - len(c)) / pairs for c in slots.T])) if len(some) > 1 else 0.5
    needed = math.log(max(2.0, n / BUCKET_ROWS)) / -math.log(min(0.95, max(0.05, shared)))
    m = int(min(MOST_FUNCTIONS, max(2, math.ceil(needed))))
    return Index(sample, directions[:, :, :m], shifts[:, :m], multipliers[:, :m], width, max(1, -(-n // CELL_ROWS)))


def probes(index: Index, table: int, at: np.ndarray, r: float) -> np.ndarray:
    """Buckets of a table in their order for a query projected to `at`, until a neighbour at distance r is in one of them
    with the probability that makes SUCCESS over all tables."""
    target = 1 - (1 - SUCCESS) ** (1 / TABLES)
    spread = max(r / index.width, 1e-9)
    reach = max(1, math.ceil(4 * spread))
    slots = np.floor(at)[:, None] + np.arange(-reach, reach + 1)
    below = np.concatenate([slots, slots[:, -1:] + 1], axis=1) - at[:, None]
    under = np.array([[math.erf(z) for z in row] for row in below / (spread * math.sqrt(2))]) / 2
    chance = np.diff(under, axis=1)
    most = chance.max(axis=1)
    rest = np.append(np.cumprod(most[::-1])[::-1][1:], 1.0)
    least = most.prod() / 2
    while True:  # all buckets of at least this chance, which falls until they suffice
        p, sums = np.ones(1), np.zeros(1, dtype=np.uint64)
        for f in range(len(at)):
            q = p[:, None] * chance[f]
            kept = q * rest[f] >= least * (1 - 1e-12)
            sums = (sums[:, None] + slots[f].astype(np.int64).astype(np.uint64) * index.multipliers[table][f])[kept]
            p = q[kept]
        if p.sum() >= target:
            break
        least /= 4
    order = np.argsort(-p, kind="stable")
    return mix(sums[order[: int(np.searchsorted(np.cumsum(p[order]), target)) + 1]])


def _indexed(rows: DataFrame, index: Index) -> DataFrame:
    """(id, v, buckets): every row with its bucket in each table."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.floor(index.projected(vectors.matrix(batch.column(1))))
                buckets = np.stack([index.bucket(t, at[t]) for t in range(TABLES)], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets.tolist(), pa.list_(pa.int64()))], names=["id", "v", "buckets"])

    return rows.select("id", "v").mapInArrow(part, f"id long, v {rows.schema['v'].dataType.simpleString()}, buckets array<long>")


def _asked(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query, q, table, cell, r, buckets): what each query visits, one row for each group of buckets."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors.matrix(batch.column(1))
            out = {c: [] for c in ("row", "table", "cell", "r", "buckets")}
            at = index.projected(v) if len(v) else np.zeros((TABLES, 0, 0))
            for i, q in enumerate(v):
                r = radius(index.sample, q, k)
                for t in range(TABLES):
                    found = probes(index, t, at[t, i], r)
                    cells = found % np.uint64(index.cells)
                    for cell in np.unique(cells):
                        for c, x in zip(out, (i, t, int(cell), r, found[cells == cell].view(np.int64)), strict=True):
                            out[c].append(x)
            at = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(out["table"], pa.int32()), pa.array(out["cell"], pa.int32()), pa.array(out["r"], pa.float64()), pa.array(out["buckets"], pa.list_(pa.int64()))],
                names=["query", "q", "table", "cell", "r", "buckets"],
            )

    return queries.select("query", "q").mapInArrow(part, f"query long, q {queries.schema['q'].dataType.simpleString()}, table int, cell int, r double, buckets array<long>")


def _everywhere(queries: DataFrame, index: Index) -> DataFrame:
    """The same for queries that visit all buckets of the first table."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(index.cells - 1))).alias("cell")
    return queries.select("query", "q", F.lit(0).alias("table"), cells, F.lit(float("inf")).alias("r"), F.lit(None).cast("array<long>").alias("buckets"))


def _searched(indexed: DataFrame, asked: DataFrame, index: Index, k: int) -> DataFrame:
    """(query, id, score): of each group of buckets, a query's k nearest rows within r in the buckets it visits."""
    rows = indexed.select("id", "v", F.posexplode("buckets").alias("table", "bucket"))
    cell = F.expr(f"CASE WHEN bucket >= 0 THEN bucket % {index.cells} ELSE (bucket % {index.cells} + {pow(2, 64, index.cells)} + {index.cells}) % {index.cells} END").cast("int")
    rows = rows.withColumn("cell", cell)

    def best(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out_query, out_id, out_score = [], [], []
        if rows.num_rows and queries.num_rows:
            buckets = rows["bucket"].to_numpy().view(np.uint64)
            order = np.argsort(buckets, kind="stable")
            buckets, ids, v = buckets[order], rows["id"].to_numpy()[order], vectors.matrix(rows["v"])[order]
            names, q, r, asked = queries["query"].to_numpy(), vectors.matrix(queries["q"]), queries["r"].to_numpy(), queries["buckets"]
            for i, name in enumerate(names):
                if asked[i].is_valid:
                    wanted = asked[i].values.to_numpy().view(np.uint64)
                    start, end = np.searchsorted(buckets, wanted), np.searchsorted(buckets, wanted, side="right")
                    held = end - start
                    at = np.repeat(start - np.concatenate([[0], np.cumsum(held)[:-1]]), held) + np.arange(held.sum())
                else:
                    at = np.arange(len(ids))
                at = at[ids[at] != name]
                d = np.sqrt(((v[at] - q[i]) ** 2).sum(axis=1))
                near = np.flatnonzero(d <= r[i] * (1 + 1e-9))
                near = near[np.lexsort((ids[at[near]], d[near]))[:k]]
                out_query.append(np.full(len(near), name))
                out_id.append(ids[at[near]])
                out_score.append(d[near])
        joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"query": joined(out_query, np.int64), "id": joined(out_id, np.int64), "score": joined(out_score, np.float64)})

    groups = vectors.keyed_blocks(rows, asked.select("query", "q", "table", "cell", "r", "buckets"), ["table", "cell"], CELL_ROWS, QUERY_BLOCK)
    return groups.applyInArrow(best, "query long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def nearest(embeddings: DataFrame, is_query, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, rank, id, score): the k nearest found by Euclidean distance to each row for which is_query(id column) holds."""
    kind = "array<float>" if embeddings.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.usable(embeddings, vector, nonzero=True).select(F.col("row")[id].cast("long").alias("id"), F.col("v").cast(kind))
    rows = materialize(vectors.one_per_id(rows, "v"))
    index = fit(rows, k)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query long, rank int, id long, score double")
    indexed = materialize(_indexed(rows, index))
    queries = rows.where(is_query(F.col("id"))).select(F.col("id").alias("query"), F.col("v").alias("q"))
    tasks = max(1, -(-queries.count() // ASKED_TOGETHER))
    asked = materialize(_asked(queries.repartition(tasks, "query"), index, k))
    found = materialize(_ranked(_searched(indexed, asked, index, k), k))
    wanted = min(k, rows.limit(k + 1).count() - 1)
    whole = found.groupBy("query").count().where(F.col("count") >= wanted)
    short = queries.join(whole, "query", "left_anti")
    if not wanted or short.isEmpty():
        return found
    rest = _ranked(_searched(indexed, _everywhere(short, index), index, k), k)
    return found.join(whole.select("query"), "query", "left_semi").unionByName(rest)
