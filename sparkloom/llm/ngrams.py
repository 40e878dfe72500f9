"""Hashed word and character n-gram features of whole texts, and the calibration of linear classifiers over them.

Features live in a fixed number of buckets, so a model's size does not depend on the data. Feature functions are
plain NumPy over one text; Spark deals out the texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import code_points, span_hashes, utf8, word_spans

#: Number of feature buckets.
BUCKETS = 1 << 18
#: Bound on the bytes of filled buckets (four each) that a model is fitted to.
FIT_BYTES = 64 << 20
#: Characters of a text whose n-grams are in memory at once.
SLICE = 1 << 20


_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
# A bucket for each way in which the three words of a word 3-gram can equal each other.
_PATTERNS = (np.arange(8, dtype=np.uint64) * _K[1] >> np.uint64(64 - BUCKETS.bit_length() + 1)).view(np.int64)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def feature_buckets(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of the word 1- and 2-grams, of the word 3-grams backed off to which of their words are equal, and of the
    character 2- and 4-grams of a whole text, with repeats, in slices."""
    data = utf8(text)
    starts, ends = word_spans(data)
    words = span_hashes(data, starts, ends)
    yield (words >> _SHIFT).view(np.int64)
    if len(words) > 1:
        yield ((words[1:] * _K[0] + words[:-1]) * _K[1] >> _SHIFT).view(np.int64)
    if len(words) > 2:
        next_same, last_same = words[1:] == words[:-1], words[2:] == words[:-2]
        yield _PATTERNS[next_same[:-1] + 2 * next_same[1:] + 4 * last_same]
    codes = data if len(data) == len(text or "") else code_points(text)
    for at in range(0, len(codes) - 1, SLICE):
        c = codes[at : at + SLICE + 3].astype(np.uint64)
        pairs = (c[:-1] << np.uint64(21)) ^ c[1:]
        yield (pairs[:SLICE] * _K[2] >> _SHIFT).view(np.int64)
        if len(pairs) > 2:
            yield (pairs[:-2] * _K[3] + pairs[2:] * _K[0] >> _SHIFT).view(np.int64)


def _filled(parts: Iterable[np.ndarray]) -> np.ndarray:
    seen = np.zeros(BUCKETS, dtype=bool)
    for filled in parts:
        seen[filled] = True
    return np.flatnonzero(seen).astype(np.int32)


def indicators(text: str | None) -> np.ndarray:
    """The buckets that a text fills, sorted, each once."""
    return _filled(feature_buckets(text))


def frequencies(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text fills and their damped counts, scaled to length 1."""
    parts = list(feature_buckets(text)) if len(text or "") <= SLICE else None  # a longer text is gone through twice
    at = _filled(feature_buckets(text) if parts is None else parts)
    place = np.empty(BUCKETS, dtype=np.int32)
    place[at] = np.arange(len(at))
    counts = np.zeros(len(at), dtype=np.int64)
    for filled in feature_buckets(text) if parts is None else [np.concatenate(parts)]:
        counts += np.bincount(place[filled], minlength=len(at))
    values = np.log1p(counts).astype(np.float32)
    return at, values / max(float(np.sqrt(values @ values)), 1e-9)


def arrow_rows(f: Callable[[list], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f over Arrow batches cut so small that a batch of long texts fits in memory."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield f(batch.slice(at, 1000))

    return run


def in_one_task(features: DataFrame) -> DataFrame:
    """features(at, ..) of a bounded sample in one partition, in an order that only the rows decide."""
    return features.repartition(1).sortWithinPartitions(F.xxhash64("at"), *features.columns)


def bounded(batches: Iterator[pa.RecordBatch], most: int, most_bytes: int = FIT_BYTES) -> list[tuple]:
    """The first rows of a sorted sample, up to a number of rows and of bytes of their first column."""
    rows, size, full = [], 0, False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) if not full else ():
            full = full or len(rows) == most or size + len(row[0]) > most_bytes
            if full:
                break
            rows.append(row)
            size += len(row[0])
    return rows


def platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a and b of the calibrated probability 1 / (1 + exp(-(a * score + b))), by Newton's method on smoothed labels."""
    pos, neg = int(labels.sum()), int(len(labels) - labels.sum())
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        d, w = target - p, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (d * scores).sum() - 1e-3 * a, d.sum()
        haa, hab, hbb = (w * scores * scores).sum() + 1e-3, (w * scores).sum(), w.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + np.clip(da, -2, 2), b + np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-7:
            break
    return float(a), float(b)


def probability(scores: np.ndarray | float, a: float, b: float):
    return 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
