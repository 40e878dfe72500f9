"""Quality rules: fixed base rules on words and repeats, then a calibrated n-gram logistic regression.

``measure_and_score`` computes the base measures of every whole text and, where the base rules pass, the
probability of good quality from hashed word and character n-grams; texts below a fixed threshold are rejected.
The regression is fitted to a bounded sample of labelled rows and calibrated on a held-back part of it.

Defined cases: null and empty texts have no words and fail the base rules; null ids are judged like others and are
never training rows; an empty or one-class training set makes the model keep every text that the base rules pass;
ties at the threshold are kept; extra columns are ignored (or passed on by ``keep_good``).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import quoted, rolling_word_hashes, span_hashes, utf8, word_spans
from sparkloom.llm.ngrams import BUCKETS, arrow_rows, bounded, frequencies, in_one_task, platt, probability

#: Bound on the labelled rows the regression is fitted to.
FIT_ROWS = 3_000
#: Words of the bit table that keeps texts without a label out of the merge; what is broadcast never exceeds it.
FILTER_WORDS = 1 << 20
#: Texts whose calibrated probability of good quality is lower are rejected.
THRESHOLD = 0.1
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Regression:
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def score(self, text: str | None) -> float:
        at, values = frequencies(text)
        return float(probability(self.weights[at] @ values + self.bias, self.a, self.b))


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    data = utf8(text)
    starts, ends = word_spans(data)
    n, symbols = len(starts), int(IS_SYMBOL[data].sum())
    if not n:
        return 0, 0, symbols, 0, 0
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\x0b\x0c\r")]
    repeated = 0
    if n >= WINDOW:
        windows = rolling_word_hashes(span_hashes(data, starts, ends), WINDOW)
        order = np.argsort(windows, kind="stable")
        twice = np.flatnonzero(windows[order[1:]] == windows[order[:-1]])
        inside = np.zeros(n + WINDOW, dtype=bool)
        for k in range(WINDOW):
            inside[order[twice] + k] = inside[order[twice + 1] + k] = True
        repeated = int(np.count_nonzero(inside))
    return n, int((points[ends] - points[starts]).sum()), symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def train(labelled: DataFrame, epochs: int = 60, most: int = FIT_ROWS) -> Regression | None:
    """Fit to labelled(text, label 0/1) by full-batch adaptive gradient steps; None when a class is missing.

    Features are taken where the texts lie; one task fits at most ``most`` rows and FIT_BYTES, and the driver
    receives the weights alone."""

    def featurize(batch):
        pairs = [frequencies(t.as_py()) for t in batch.column(0)]
        return pa.record_batch([pa.array([p[0].tobytes() for p in pairs], type=pa.binary()), pa.array([p[1].astype(np.float32).tobytes() for p in pairs], type=pa.binary()), batch.column(1)], names=["at", "v", "label"])

    def fitted(batches):
        model = fit(bounded(batches, most), epochs)
        if model is not None:
            yield pa.RecordBatch.from_pylist([asdict(model) | {"weights": model.weights.tobytes()}])

    labelled = labelled.select("text", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    features = labelled.mapInArrow(arrow_rows(featurize), "at binary, v binary, label int")
    found = in_one_task(features).mapInArrow(fitted, "weights binary, bias double, a double, b double").collect()
    return Regression(np.frombuffer(found[0]["weights"], dtype=np.float32), found[0]["bias"], found[0]["a"], found[0]["b"]) if found else None


def fit(rows: list[tuple[bytes, bytes, int]], epochs: int) -> Regression | None:
    """The regression for sorted rows of filled buckets (int32), their values (float32) and label."""
    y = np.array([r[2] for r in rows])
    if not len(rows) or y.min() == y.max():
        return None
    held = np.random.default_rng(3).permutation(len(rows)) < len(rows) // 5
    lengths = np.array([len(r[0]) // 4 for r in rows])
    cols = np.frombuffer(b"".join(r[0] for r in rows), dtype=np.int32)
    vals = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.float32)
    del rows
    bounds = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    of = np.repeat(np.arange(len(y)), lengths)
    use = ~held[of]
    w, g2, bias = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0
    balance = np.where(y == 1, 0.5 / max(y[~held].mean(), 1e-9), 0.5 / max(1 - y[~held].mean(), 1e-9)) * ~held
    margins = np.add.reduceat(w[cols] * vals, bounds) + bias
    for _ in range(epochs):
        d = (probability(margins, 1.0, 0.0) - y) * balance / max(1, (~held).sum())
        grad = np.bincount(cols[use], weights=(d[of] * vals)[use], minlength=BUCKETS) + 1e-6 * w
        g2 += grad * grad
        w -= 0.3 * grad / np.sqrt(g2)
        bias -= 2.0 * d.sum()
        margins = np.add.reduceat(w[cols] * vals, bounds) + bias
    a, b = platt(margins[held], y[held]) if held.sum() >= 10 and 0 < y[held].mean() < 1 else (1.0, 0.0)
    return Regression(w.astype(np.float32), bias, a, b)


def measure_and_score(docs: DataFrame, model: Regression | None, text: str = "text") -> DataFrame:
    """docs with a struct column ``quality``: the measures, base_failed, score (null where the base rules reject) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def judged(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            t = t.as_py()
            m = measures(t)
            failed = base_failed(m[0], m[4])
            score = None if failed else 1.0 if shared.value is None else shared.value.score(t)
            rows.append(dict(zip(names, m, strict=True)) | {"base_failed": failed, "score": score, "kept": not failed and score >= THRESHOLD})
        kinds = [*((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())]
        return pa.array(rows, type=pa.struct(kinds))

    return docs.withColumn("quality", F.arrow_udf(judged, f"{MEASURES}, base_failed boolean, score double, kept boolean")(F.col(text)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the base rules or the model reject; labels(doc_id, quality) teach the model."""
    model = train(labelled_rows(docs, labels, FIT_ROWS))
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("document"), "text")  # whatever its columns are called
    kept = measure_and_score(whole, model).where("quality.kept")
    return kept.select(*[F.col(f"document.{quoted(c)}").alias(c) for c in docs.columns])


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """(text, label) of the docs that labels name.

    With a bound, that many labels (the first by a hash of the id) are chosen before any text is read, and as so few
    they are broadcast. Without one both sides are merged, at every size alike, after most texts without a label have
    been left out by a bit table of fixed size."""
    docs = docs.select("doc_id", "text")
    known = labels.select(F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    if most is None:
        return _maybe_named(docs, known).join(known.hint("merge"), "doc_id").select("text", "label")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "label").limit(most)
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "label")


def _maybe_named(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs(doc_id, text) less rows whose id surely is not in known: one bit per id, in at most FILTER_WORDS words of 64."""
    word = F.expr(f"pmod(shiftright(xxhash64(doc_id), 6), {FILTER_WORDS})").alias("word")
    bit = "cast(xxhash64(doc_id) & 63 as int)"
    bits = known.groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits"))
    return docs.withColumn("word", word).join(F.broadcast(bits), "word").where(f"getbit(bits, {bit}) = 1").select("doc_id", "text")
