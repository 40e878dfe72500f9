"""Exact similarity search over vector columns, in blocks of bounded size, of which a task multiplies two at a time.

More than one block of vectors is dealt by nearest pivot, and a pivot's vectors are cut into as many blocks as they need.
Angles obey the triangle inequality: vectors of two pivots are at least as far apart as the pivots less the radii around
them, so pairs of pivots, or of a query and a pivot, that can hold nothing near enough are skipped, and nothing else is.
Pivots come from a bounded sample and only say where to look; vectors spread evenly skip little, clustered ones most.
A task takes a group of blocks, of which there are at most GROUPS until one holds MOST_VALUES numbers, so a row is sent to a
bounded number of tasks and what is shuffled grows as the collection does; vectors are sent in as few bytes as hold their
very values, and stay so in a task but for single precision. Products are made in single precision, a slice of queries at a time, and whatever they don't
rule out is computed again in double precision. Where a threshold is high, vectors are folded to fewer numbers first, whose
products bound those of the whole ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import materialize

#: Rows of a block, on average; a task multiplies two blocks at a time. Of more than MOST_BLOCKS times as many rows the
#: blocks are larger, up to MOST_VALUES numbers (262,144 vectors of 64).
BLOCK, MOST_BLOCKS, MOST_VALUES = 2048, 16, 1 << 24
#: Groups of blocks that meet, each pair of them in a task.
GROUPS = 6
#: What a vector's numbers are sent as.
KINDS = (np.int8, np.int16, np.float32, np.float64)
#: Products made at a time in a task, candidates computed again at a time, vectors folded at a time.
SLICE, AGAIN, FOLD = 1 << 22, 1 << 16, 1 << 13
#: What single precision may take from a product of unit vectors, with room, and from which two scores can't be ties.
SINGLE, TIE = 1e-4, 2e-9
#: Rows and columns of a tile of folded products; the share of a tile's pairs above which its whole products are made first.
TILE, FEW = (512, 2048), 0.005
#: Pivots at most, and rows of the sample they are chosen from; with more vectors a pivot has more blocks.
PIVOTS, SAMPLE = 512, 4096
#: Added to angles, for what rounding takes from them.
LOOSE = 1e-6


def _sizes(rows: DataFrame, partitions: int | None = None) -> tuple[int, int]:
    """How many blocks, and rows of one."""
    if partitions:
        return partitions, BLOCK
    n, long = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    size = max(BLOCK, min(MOST_VALUES // max(1, long or 1), -(-n // MOST_BLOCKS)))
    return max(1, -(-n // size)), size


def _packed(column: pa.Array) -> pa.Array:
    """Each vector in the narrowest of KINDS that holds its numbers exactly, after a byte that names it."""
    if not len(column):
        return pa.array([], pa.binary())
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    kind = np.full(len(m), len(KINDS) - 1)
    for k in range(len(KINDS) - 2, -1, -1):
        with np.errstate(invalid="ignore", over="ignore"):
            kind[(m.astype(KINDS[k]) == m).all(axis=1)] = k
    return pa.array([bytes([k]) + v.astype(KINDS[k]).tobytes() for k, v in zip(kind.tolist(), m, strict=True)], pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    kind = np.array([r[0] for r in rows])
    out = np.zeros((len(rows), (len(rows[0]) - 1) // np.dtype(KINDS[rows[0][0]]).itemsize), KINDS[kind.max()])
    for k in np.unique(kind).tolist():
        at = np.flatnonzero(kind == k)
        out[at] = np.frombuffer(b"".join([rows[i][1:] for i in at]), KINDS[k]).reshape(len(at), -1)
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    if pa.types.is_binary(column.type):
        return _unpacked(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Units:
    """Rows as unit vectors: kept as they were sent, made single or double where they are asked for."""

    def __init__(self, column: pa.Array):
        self.numbers = _numbers(column)
        squares = [(m * m).sum(axis=1) for m in (self.numbers[at : at + AGAIN].astype(np.float64) for at in range(0, len(self.numbers), AGAIN))]
        self.squares = np.concatenate(squares) if squares else np.zeros(0)
        self.norms = np.maximum(np.sqrt(self.squares), 1e-300)[:, None]

    def __len__(self) -> int:
        return len(self.numbers)

    def double(self, at=slice(None)) -> np.ndarray:
        return self.numbers[at].astype(np.float64) / self.norms[at]

    def single(self, at=slice(None)) -> np.ndarray:
        return self.double(at).astype(np.float32)

    def folded(self, n: int) -> np.ndarray:
        """Turned at random, so that all numbers weigh alike, then the first n of them and the length of the rest: products
        of these are never below those of the whole vectors."""
        d = self.numbers.shape[1]
        turn = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0][:, :n]
        out = np.zeros((len(self), n + 1), np.float32)
        for at in range(0, len(self), FOLD):
            x = self.double(slice(at, at + FOLD))
            y = x @ turn
            out[at : at + FOLD, :n] = y
            out[at : at + FOLD, n] = np.sqrt(np.maximum((x * x).sum(axis=1) - (y * y).sum(axis=1), 0))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return Units(column).double()


@dataclass
class Places:
    """Where vectors lie: pivots as unit vectors, and of each the rows, the largest angle to them, and the blocks."""

    size: int
    pivots: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray
    rows: np.ndarray

    def angles(self, unit: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit @ self.pivots.T, -1, 1))

    def asked(self, unit: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Which pivots queries ask: their own one first, later all others that may hold more than they know of."""
        angles = self.angles(unit)
        mine = np.arange(len(self.pivots))[None, :] == angles.argmin(axis=1)[:, None]
        least = np.arccos(np.clip(np.nan_to_num(kth, nan=-1.0) - 1e-9, -1, 1))[:, None] + LOOSE
        return np.where(np.isnan(kth)[:, None], mine, ~mine & (angles - self.radius - LOOSE <= least))

    def groups(self, blocks: int) -> list[list[int]]:
        """Of each pivot's blocks the group they lie in: the fullest first, each into what is the emptiest group by then."""
        counts = {(p, b): self.rows[p] / n for p, n in enumerate(self.blocks.tolist()) for b in range(n)}
        most = max(1, MOST_VALUES // self.pivots.shape[1])
        filled = [0.0] * max(1, min(len(counts), max(min(GROUPS, blocks), -(-int(self.rows.sum()) // most))))
        out = [[0] * max(1, n) for n in self.blocks.tolist()]
        for (p, b), n in sorted(counts.items(), key=lambda c: -c[1]):
            out[p][b] = filled.index(min(filled))
            filled[out[p][b]] += n
        return out

    def near(self, least: float) -> list[tuple[int, int]]:
        """Pairs p <= q of pivots whose vectors may have a cosine of at least ``least``."""
        apart = self.angles(self.pivots) - self.radius[:, None] - self.radius[None, :] - LOOSE
        return [(int(p), int(q)) for p, q in np.argwhere(apart <= np.arccos(np.clip(least, -1, 1))) if p <= q and self.blocks[p] and self.blocks[q]]


def _pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """n vectors of a sample, each the one farthest from those before it."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"]
    unit = _matrix(sample.combine_chunks())
    directed = unit[(unit * unit).sum(axis=1) > 0.5]  # a vector of zeros has no direction, and would always be the farthest
    if not len(directed):
        return unit[:1]
    unit = directed
    chosen, closest = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, unit @ unit[chosen[-1]])
    return unit[chosen]


def _placed(vectors: DataFrame, blocks: int, size: int) -> tuple[DataFrame, Places]:
    """vectors(id, v) with their pivot and block of it, written once, and the places."""
    pivots = _pivots(vectors, min(PIVOTS, blocks))

    def nearest(column: pa.Array) -> pa.Array:
        cosines = _matrix(column) @ pivots.T if len(column) else np.zeros((0, 1))
        at = cosines.argmax(axis=1)
        angle = np.arccos(np.clip(cosines[np.arange(len(at)), at], -1, 1))
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(angle)], names=["pivot", "angle"])

    rows = materialize(vectors.select("id", F.arrow_udf(_packed, "binary")("v").alias("v"), F.arrow_udf(nearest, "pivot int, angle double")("v").alias("at")).select("id", "v", "at.pivot", "at.angle"))
    places = Places(size, pivots, np.zeros(len(pivots)), np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots), dtype=np.int64))
    for r in rows.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # PIVOTS rows at most
        places.radius[r["pivot"]], places.blocks[r["pivot"]], places.rows[r["pivot"]] = r["radius"], -(-r["n"] // size), r["n"]
    many = F.element_at(F.array(*[F.lit(int(max(1, b))) for b in places.blocks]), F.col("pivot") + 1)
    group = F.array(*[F.array(*[F.lit(g) for g in gs]) for gs in places.groups(blocks) or [[0]]])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), many).cast("int"))
    return rows.withColumn("part", F.element_at(F.element_at(group, F.col("pivot") + 1), F.col("block") + 1)), places


def _products(left: Units, right: Units, rows=None, columns=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The products of unit vectors in single precision, a slice of left at a time, with its rows of left."""
    rows = np.arange(len(left)) if rows is None else rows
    across = right.single(slice(None) if columns is None else columns).T
    step = max(1, SLICE // max(1, across.shape[1]))
    for at in range(0, len(rows), step):
        yield rows[at : at + step], left.single(rows[at : at + step]) @ across


def _kept(d: int, least: float) -> int | None:
    """How many numbers of d to keep so that folded products of vectors with nothing in common, but for one in some ten
    thousand, stay below ``least``; None where that is half of them or more."""
    return next((n for n in range(1, d // 2) if n - 4 * np.sqrt(n) >= (1 - least) * d), None)


def _close(left: Units, right: Units, rows: np.ndarray, columns: np.ndarray, least: float, folded: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): the places in left and right of pairs that their products in single precision don't rule out."""
    if folded is None:
        for at, cosines in _products(left, right, rows, columns):
            i, j = np.nonzero(cosines >= least - SINGLE)
            yield at[i], columns[j]
        return
    across = folded[1][columns]
    for r in range(0, len(rows), TILE[0]):
        at = rows[r : r + TILE[0]]
        mine = folded[0][at]
        for c in range(0, len(columns), TILE[1]):
            to = columns[c : c + TILE[1]]
            i, j = np.divmod(np.flatnonzero(mine @ across[c : c + TILE[1]].T >= least - SINGLE), len(to))
            if len(i) > FEW * len(at) * len(to):
                i, j = np.nonzero(left.single(at) @ right.single(to).T >= least - SINGLE)
            if len(i):
                yield at[i], to[j]


def _cosines(left: Units, right: Units, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """One rounded root under one product, so vectors of whole numbers that lie at a threshold, as 22/25 at 0.88, meet it."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        squares = left.squares[i] * right.squares[j]
        scores = np.clip(np.einsum("ij,ij->i", left.numbers[i].astype(np.float64), right.numbers[j].astype(np.float64)) / np.sqrt(squares), -1, 1)
    odd = np.flatnonzero(~((squares > 1e-280) & (squares < 1e280)))  # out of a double's range, or no direction
    if len(odd):
        scores[odd] = np.einsum("ij,ij->i", left.double(i[odd]), right.double(j[odd]))
    return scores


def _exact(left: Units, right: Units, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [_cosines(left, right, i[at : at + AGAIN], j[at : at + AGAIN]) for at in range(0, len(i), AGAIN)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _own(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with names[i] == ids[j]."""
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids, names, side, sorter=order) for side in ("left", "right"))
    n = high - low
    return np.repeat(np.arange(len(names)), n), order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def _best(k: int, places: Places | None = None):
    """A task of top_k: the k best rows for each query, of those that reach the score it has k times.

    With places a query meets only rows of the pivots that it asks."""

    def best(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and vectors.num_rows:
            all_ids, names = vectors["id"].to_numpy(), queries["query"].to_numpy()
            left, right = Units(queries["v"].combine_chunks()), Units(vectors["v"].combine_chunks())
            kth = queries["kth"].to_numpy()
            pivots = vectors["pivot"].to_numpy() if places else np.zeros(len(all_ids), int)
            asks = np.concatenate([places.asked(left.double(slice(at, at + AGAIN)), kth[at : at + AGAIN]) for at in range(0, len(left), AGAIN)]) if places else None
            for p in np.unique(pivots).tolist():
                columns = np.flatnonzero(pivots == p)
                rows = np.flatnonzero(asks[:, p]) if places else np.arange(len(names))
                ids, most = all_ids[columns], min(k, len(columns))
                for at, near in _products(left, right, rows, columns):
                    own = _own(names[at], ids)
                    near[own] = -2
                    least = np.nan_to_num(kth[at], nan=-1.5) - TIE - SINGLE
                    many = np.flatnonzero(np.count_nonzero(near >= least[:, None], axis=1) > 8 * k)
                    if len(many):
                        at_k = np.partition(near[many], len(ids) - most, axis=1)[:, len(ids) - most]
                        least[many] = np.maximum(least[many], at_k - TIE - 2 * SINGLE)
                    row, column = np.nonzero(near >= np.maximum(least, -1.75)[:, None])
                    scores = _exact(left, right, at[row], columns[column])
                    found.append(_first(k, names[at[row]], ids[column], scores))
        query, id_, score = _first(k, *(np.concatenate(c) for c in zip(*found, strict=True)))
        return pa.table({"query": query, "id": id_, "score": score})

    return best


def _first(k: int, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query."""
    order = np.lexsort((ids, -np.round(scores, 9), query))
    query, ids, scores = query[order], ids[order], scores[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[keep], scores[keep]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _met(queries: DataFrame, rows: DataFrame, places: Places, parts: list[list[int]], asked: int, k: int) -> DataFrame:
    """What queries(query, v, kth) find in the groups of blocks that hold pivots they ask; queries are dealt into so many lots."""
    holds = np.zeros((len(parts), 1 + max(g for gs in parts for g in gs)), bool)
    for p, gs in enumerate(parts):
        holds[p, gs] = places.blocks[p] > 0

    def dealt(batches):
        for batch in batches:
            asks = places.asked(_matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, len(holds)), bool)
            at, part = np.nonzero(asks.astype(np.int64) @ holds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in range(3)), pa.array(part, pa.int32())], names=["query", "v", "kth", "part"])

    left = queries.mapInArrow(dealt, "query long, v binary, kth double, part int").withColumn("lot", F.pmod(F.xxhash64("query"), F.lit(asked)).cast("int"))
    right = rows.select("part", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("lot"), "id", "v", "pivot")
    return left.groupBy("part", "lot").cogroup(right.groupBy("part", "lot")).applyInArrow(_best(k, places), "query long, id long, score double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, partitions: int | None = None) -> DataFrame:
    """(query, id, score, rank): the k nearest of vectors(id, v) to each of queries(query, v) by cosine, other than itself.

    Scores equal to nine places are ties, which go to the smaller id; they are returned unrounded. A query first meets
    the vectors of its own pivot; its k-th score there says which other pivots can hold better ones."""
    blocks, size = _sizes(vectors, partitions)
    if blocks == 1:  # nothing to skip
        n = -(-queries.count() // BLOCK) or 1
        left = queries.select(F.pmod(F.xxhash64("query"), F.lit(n)).cast("int").alias("part"), F.col("query").alias("query"), F.col("v").alias("v"), F.lit(None).cast("double").alias("kth"))
        right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), F.col("id").alias("id"), F.col("v").alias("v"))
        return _ranked(left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(_best(k), "query long, id long, score double"), k)
    rows, places = _placed(vectors, blocks, size)
    if not len(places.pivots):
        return _ranked(vectors.sparkSession.createDataFrame([], "query long, id long, score double"), k)

    parts, queries = places.groups(blocks), queries.select("query", F.arrow_udf(_packed, "binary")("v").alias("v"))
    asked = max(1, min(-(-queries.count() // size), 1 + max(g for gs in parts for g in gs)))
    mine = queries.select("query", "v", F.lit(None).cast("double").alias("kth"))
    first = materialize(_ranked(_met(mine, rows, places, parts, min(2, asked), k), k))  # a query is in few groups here
    kth = first.where(F.col("rank") == k).select("query", F.round("score", 9).alias("kth"))
    rest = queries.select("query", "v").join(kth, "query", "left").select("query", "v", F.coalesce("kth", F.lit(-1.0)).alias("kth"))
    found = first.drop("rank").unionByName(_met(rest, rows, places, parts, asked, k))
    return _ranked(found, k)


def similar_pairs(vectors: DataFrame, least: float, partitions: int | None = None) -> DataFrame:
    """(a, b, score): all pairs a < b of vectors(id, v) with a cosine of at least ``least``.

    Blocks of bounded size meet, each pair of blocks as a group of its own, unless their pivots are too far apart."""
    blocks, size = _sizes(vectors, partitions)

    def close(near: np.ndarray | None):
        """A task: the pairs of two groups. With ``near`` only rows of pivots that may be near enough meet."""

        def pairs(key, left: pa.Table, right: pa.Table) -> pa.Table:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if left.num_rows and right.num_rows:
                a, b = left["id"].to_numpy(), right["id"].to_numpy()
                x, y = Units(left["v"].combine_chunks()), Units(right["v"].combine_chunks())
                p, q = (t["pivot"].to_numpy() if near is not None else np.zeros(len(t), int) for t in (left, right))
                one = key[0].as_py() == key[1].as_py()
                kept = _kept(x.numbers.shape[1], least)
                folded = (x.folded(kept), y.folded(kept)) if kept else None
                for pivot in np.unique(p).tolist():
                    # Within a group each pair of pivots meets once, and rows of one pivot meet twice.
                    columns = np.flatnonzero((near[pivot, q] if near is not None else q == pivot) & ((q >= pivot) | (not one)))
                    for i, j in _close(x, y, np.flatnonzero(p == pivot), columns, least, folded) if len(columns) else ():
                        once = (a[i] < b[j]) | ((p[i] != q[j]) & (a[i] != b[j])) if one else a[i] != b[j]
                        i, j = i[once], j[once]
                        scores = _exact(x, y, i, j)
                        keep = scores >= least
                        i, j = i[keep], j[keep]
                        found.append((np.minimum(a[i], b[j]), np.maximum(a[i], b[j]), scores[keep]))
            low, high, score = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.table({"a": low, "b": high, "score": score})

        return pairs

    by, out = ["i", "j"], "a long, b long, score double"
    if blocks == 1:  # nothing to skip
        one = [F.lit(0).alias(c) for c in by]
        left, right = (vectors.select(*one, F.col("id").alias("id"), F.col("v").alias("v")) for _ in range(2))
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(close(None), out)
    rows, places = _placed(vectors, blocks, size)
    near = np.zeros((len(places.pivots), len(places.pivots)), bool)
    cells = set()
    parts = places.groups(blocks)
    for p, q in places.near(least):
        near[p, q] = near[q, p] = True
        cells |= {(min(i, j), max(i, j)) for i in set(parts[p]) for j in set(parts[q])}
    cells = F.broadcast(materialize(vectors.sparkSession.createDataFrame(sorted(cells), "i int, j int")))  # a row per pair of groups
    left = rows.join(cells, F.col("part") == F.col("i")).select("i", "j", "id", "v", "pivot")
    right = rows.toDF(*rows.columns).join(cells.toDF("i2", "j2"), F.col("part") == F.col("j2")).select(F.col("i2").alias("i"), F.col("j2").alias("j"), "id", "v", "pivot")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(close(near), out)


def skipped_share(vectors: DataFrame, least: float, partitions: int | None = None) -> tuple[int, int]:
    """How many pairs of blocks similar_pairs() skips, of how many there are."""
    _, places = _placed(vectors, *_sizes(vectors, partitions))
    count = lambda p, q: int(places.blocks[p] * places.blocks[q]) if p < q else int(places.blocks[p] * (places.blocks[p] + 1) // 2)
    n = int(places.blocks.sum())
    return n * (n + 1) // 2 - sum(count(p, q) for p, q in places.near(least)), n * (n + 1) // 2
