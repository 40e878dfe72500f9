"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The distinct vectors, as integers, are the fit list X. A step of the bidiagonalisation multiplies the centred rows by a
direction (Xv) and their products by the rows again (Xᵀu), in one pass over the rows: a left vector u lies spread over
the rows as Xy, so only its short coefficients y and Xᵀu ever reach the driver. Both sides are fully reorthogonalised,
the left one through uᵢᵀu = yᵢᵀ(Xᵀu). The singular value decomposition of the small bidiagonal matrix gives components
and deviations. A run that meets an invariant subspace, or has converged, is followed by one orthogonal to what is
found, until that brings nothing larger; so equal eigenvalues are found as often as they occur.

Defined cases: rows whose vector is null, empty, holds null or non-finite entries or has another length than most take
no part; repeated rows count once in the fit and are all returned; components stop where the variance ends, so a table
of equal vectors, one row or none gives no rows; a deviation too large for a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import vectors
from sparkloom.llm.common import materialize

SEED = 1
#: Relative to the largest possible singular value: below, a length is zero; residuals must be smaller to have converged.
ZERO, CONVERGED = 1e-11, 1e-14


@dataclass
class Whitening:
    n: int  # vectors of the fit list
    sums: list[int]  # of each dimension
    components: np.ndarray  # one unit vector a column, by falling variance
    variances: np.ndarray  # of each component, divisor n
    trace: float  # of the covariance
    identity_error: float = 0.0


def as_integers(v: str):
    """64 times each entry, rounded down, plus a million: long arithmetic on them is exact."""
    return F.transform(v, lambda c: F.floor(64 * c) + F.lit(1_000_000).cast("long"))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n without cancellation: whole parts as integers, then the fraction."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return (x - whole) - np.array([s % n / n for s in sums])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"block": pa.array([vectors.matrix(batch.column(0), np.int64).tobytes()], pa.binary())})


def _summed(blocks: DataFrame, n: int, sums: list[int], f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of f over the centred rows, block by block: one short vector a task, added up by Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column(0):
                value = f(_centred(np.frombuffer(block.as_buffer(), np.int64).reshape(-1, len(sums)), n, sums))
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": np.arange(len(total), dtype=np.int32), "value": total})

    rows = blocks.mapInArrow(part, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max(r["place"] for r in rows) + 1)
    for r in rows:
        out[r["place"]] = r["value"]
    return out


def _orthogonal(w: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """w without its parts along the columns of the bases; twice is enough."""
    for _ in range(2):
        for basis in bases:
            w = w - basis @ (basis.T @ w)
    return w


def _run(product: Callable, found: np.ndarray, wanted: int, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One bidiagonalisation orthogonal to found: singular values and right vectors, all if the run has closed, else the wanted ones."""
    d = found.shape[0]
    right, left, images = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V; Y with U = XY; XᵀU
    v = _orthogonal(rng.standard_normal(d), found)
    v, beta, small = v / np.linalg.norm(v), 0.0, np.zeros((0, 0))
    while True:
        right = np.column_stack([right, v])
        k = right.shape[1]
        y = v - beta * left[:, -1] if k > 1 else v
        image, squared = product(y)  # Xᵀ(Xy) and |Xy|²
        for _ in range(2):
            along = left.T @ image
            y, image, squared = y - left @ along, image - images @ along, squared - along @ along
        alpha = np.sqrt(max(squared, 0.0))
        grown = np.zeros((k, k))
        grown[: k - 1, : k - 1] = small
        if k > 1:
            grown[k - 2, k - 1] = beta
        small = grown
        closed = alpha <= ZERO * scale
        if not closed:
            small[k - 1, k - 1] = alpha
            left, images = np.column_stack([left, y / alpha]), np.column_stack([images, image / alpha])
            w = _orthogonal(image / alpha - alpha * v, right, found)
            beta = np.linalg.norm(w)
            closed = beta <= ZERO * scale or k + found.shape[1] == d
        p, values, q = np.linalg.svd(small)
        if not closed and (k < wanted or (beta * np.abs(p[-1, :wanted]) > CONVERGED * scale).any()):
            v = w / beta
            continue
        if not closed:
            values, q = values[:wanted], q[:wanted]
        out = right @ q.T
        return values, out / np.linalg.norm(out, axis=0)


def _components(product: Callable, d: int, wanted: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    values, found = np.zeros(0), np.zeros((d, 0))
    while found.shape[1] < d:
        least = np.sort(values)[-wanted] if len(values) >= wanted else 0.0
        new, directions = _run(product, found, 1 if len(values) else wanted, scale, rng)
        values, found = np.concatenate([values, new]), np.column_stack([found, directions])
        if new[0] <= max(least, ZERO * scale):
            break
    best = np.argsort(-values, kind="stable")[:wanted]
    best = best[values[best] > 10 * ZERO * scale]
    return values[best], found[:, best]


def fit(x: DataFrame, components: int = 16) -> Whitening:
    """The whitening of the distinct vectors of x(x array<long>), which all have one length."""
    distinct = materialize(x.select("x").distinct())
    size = distinct.select(F.size("x")).head(1)
    if not size:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    d, n = size[0][0], distinct.count()
    sums = distinct.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(sums, key=lambda r: r["pos"])]
    blocks = materialize(distinct.mapInArrow(_pack, "block binary"))
    total = float(_summed(blocks, n, sums, lambda a: np.array([(a * a).sum()]))[0])

    def product(y: np.ndarray) -> tuple[np.ndarray, float]:
        def f(a: np.ndarray) -> np.ndarray:
            t = a @ y
            return np.append(a.T @ t, t @ t)

        out = _summed(blocks, n, sums, f)
        return out[:-1], float(out[-1])

    if total <= 0:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    values, directions = _components(product, d, min(components, d), np.sqrt(total))
    model = Whitening(n, sums, directions, values**2 / n, total / n)
    k = len(values)

    def covariance(a: np.ndarray) -> np.ndarray:
        w = a @ directions / np.sqrt(model.variances)
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    out = _summed(blocks, n, sums, covariance)
    mean = out[k * k :] / n
    model.identity_error = float(np.abs(out[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return model


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, component, deviation, whitened) of rows(id, x array<long>) for each component; ids may be null or repeat."""
    n, sums, k = model.n, model.sums, len(model.variances)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, component int, deviation long, whitened double"
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    scaled = model.components / np.sqrt(model.variances)
    total = np.array(sums, dtype=object)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = vectors.matrix(batch.column(1), np.int64)
                near = _centred(x, n, sums)
                if np.abs(near).max(initial=0.0) * n < 2.0**62 and n * float(np.abs(x).max(initial=0)) < 2.0**62 and float((near * near).sum(axis=1).max(initial=0.0)) * n * n < 2.0**62:
                    apart = n * x - np.array(sums, dtype=np.int64)
                    deviation = (apart * apart).sum(axis=1).tolist()
                else:
                    deviation = [s if s < 1 << 63 else None for s in (((n * x.astype(object) - total) ** 2).sum(axis=1))]
                rows_at = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows_at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(deviation, pa.int64()).take(pa.array(rows_at)), pa.array((near @ scaled).ravel())],
                    names=["id", "component", "deviation", "whitened"],
                )

    return rows.select("id", "x").mapInArrow(part, schema)


def whiten(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 16) -> tuple[DataFrame, Whitening]:
    """The whitened rows, (id, component, deviation, whitened), and the model they were whitened by."""
    rows = vectors.usable(embeddings, vector).select(F.col("row")[id].alias("id"), as_integers("v").alias("x"))
    model = fit(rows, components)
    return transform(rows, model), model
