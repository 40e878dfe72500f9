"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

The class log-count ratio of every feature bucket is counted over all labelled training rows on the executors.
A linear model with hinge loss is then fitted by dual coordinate descent to the ratio-scaled indicators of a
bounded sample of training rows in one task, and its margin is calibrated to a probability on a held-back fifth of
that sample; the driver receives the weights alone. All texts are scored in Arrow batches with the model as a fixed-size array.

Defined cases: null and empty texts have no n-grams and get the score of the bias; null ids are never training
rows; a missing or one-class training set gives the share of label 1 (0.5 when there are no labels) as every
score; repeated label rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.ngrams import BUCKETS, arrow_rows, bounded, in_one_task, indicators, platt, probability

#: Bound on the rows that the linear model is fitted to; the ratios use all rows.
FIT_ROWS = 4_000


@dataclass(frozen=True)
class NBSVM:
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum() / max(np.sqrt(len(at)), 1.0) + self.bias)

    def score(self, at: np.ndarray) -> float:
        return float(probability(self.margin(at), self.a, self.b))


def log_count_ratios(labelled: DataFrame) -> tuple[np.ndarray, int, int]:
    """The rows of label 0 and 1, and before them log((p / |p|) / (q / |q|)) of each bucket, p and q being 1 + the texts of either class that fill it; labelled has text and label."""

    def count(batches):
        sums = np.zeros((2, BUCKETS + 1), dtype=np.int64)  # the last bucket counts the rows
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                sums[int(label.as_py() == 1), np.append(indicators(text.as_py()), BUCKETS)] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.record_batch([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["bucket", "n0", "n1"])

    counted = labelled.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0"), F.sum("n1")).toPandas().to_numpy()
    p, q = np.ones(BUCKETS + 1), np.ones(BUCKETS + 1)
    if len(counted):
        q[counted[:, 0]] += counted[:, 1]
        p[counted[:, 0]] += counted[:, 2]
    n0, n1 = int(q[-1] - 1), int(p[-1] - 1)
    p, q = p[:-1], q[:-1]
    return np.log(p / p.sum()) - np.log(q / q.sum()), n0, n1


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, c: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """The hinge-loss weights (over plain indicators, ratios multiplied in) and the bias; labels are -1 and 1."""
    w, bias = np.zeros(len(ratios)), 0.0
    values = [ratios[at] / max(np.sqrt(len(at)), 1.0) for at in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = labels[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c)
            if step := (new - alpha[i]) * labels[i]:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w * ratios, bias


def train(labelled: DataFrame, sample: DataFrame, most: int = FIT_ROWS) -> NBSVM:
    """Count ratios over all of labelled(text, label 0/1); one task fits at most ``most`` rows of sample(text, label)."""
    labelled = labelled.select("text", "label").where("label in (0, 1)")
    ratios, n0, n1 = log_count_ratios(labelled)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return NBSVM(np.zeros(BUCKETS), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))

    def featurize(batch):
        return pa.record_batch([pa.array([indicators(t.as_py()).tobytes() for t in batch.column(0)], type=pa.binary()), batch.column(1)], names=["at", "label"])

    shared = labelled.sparkSession.sparkContext.broadcast(ratios)

    def fitted(batches):
        model = fit(bounded(batches, most), shared.value)
        yield pa.RecordBatch.from_pylist([asdict(model) | {"weights": model.weights.tobytes()}])

    sample = sample.select("text", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    features = sample.mapInArrow(arrow_rows(featurize), "at binary, label int")
    found = in_one_task(features).mapInArrow(fitted, "weights binary, bias double, a double, b double").first()
    return NBSVM(np.frombuffer(found["weights"], dtype=np.float32), found["bias"], found["a"], found["b"])


def fit(rows: list[tuple[bytes, int]], ratios: np.ndarray) -> NBSVM:
    """The model for rows of filled buckets (int32) and label: calibrated on a fifth that a first fit leaves out, then fitted to all."""
    at = [np.frombuffer(x, dtype=np.int32) for x, _ in rows]
    y = np.array([1 if label == 1 else -1 for _, label in rows])
    calibrate = np.random.default_rng(3).permutation(len(rows)) < len(rows) // 5
    half, b0 = dual_coordinate_descent([x for x, c in zip(at, calibrate, strict=True) if not c], y[~calibrate], ratios)
    part = NBSVM(half, b0, 1.0, 0.0)
    held = np.array([part.margin(x) for x, c in zip(at, calibrate, strict=True) if c])
    a, b = platt(held, (y[calibrate] + 1) // 2) if len(held) >= 10 else (1.0, 0.0)
    w, bias = dual_coordinate_descent(at, y, ratios)
    return NBSVM(w.astype(np.float32), float(bias), a, b)


def score_texts(docs: DataFrame, model: NBSVM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch):
        model = shared.value
        return pa.record_batch([batch.column(0), pa.array([model.score(indicators(t.as_py())) for t in batch.column(1)], type=pa.float64())], names=["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(arrow_rows(score), f"key {kind}, score double").withColumnRenamed("key", key)
