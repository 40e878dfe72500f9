"""Exact vector search with skipped blocks against all products."""

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.operators import vectors


def clustered(n, d, clusters, spread, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    x = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, d))
    x[:3] = x[3]  # copies
    x[7] = 0
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)


def cosines(x):
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return unit @ unit.T


@pytest.mark.parametrize(("spread", "least", "block"), [(0.1, 0.8, 30), (1.5, 0.3, 50), (0.1, -0.2, 60)])
def test_pairs_equal_all_products(spark, monkeypatch, spread, least, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    x = clustered(260, 6, 9, spread)
    got = {(r["a"], r["b"]): r["score"] for r in vectors.similar_pairs(frame(spark, x), least).collect()}
    c = cosines(x)
    assert set(got) == {(a, b) for a, b in np.argwhere(c >= least) if a < b} and all(abs(got[p] - c[p]) < 1e-12 for p in got)


@pytest.mark.parametrize("spread", [0.1, 1.5])
def test_nearest_equal_all_products(spark, monkeypatch, spread):
    monkeypatch.setattr(vectors, "BLOCK", 30)
    x = clustered(240, 6, 8, spread)
    rows = frame(spark, x)
    got = {}
    for r in vectors.top_k(rows, rows.where("id % 3 = 0").withColumnRenamed("id", "query"), 4).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], r["score"])
    c = cosines(x)
    for q in range(0, 240, 3):
        order = [i for i in np.lexsort((np.arange(240), -np.round(c[q], 9))) if i != q][:4]
        assert [got[q][n][0] for n in range(1, 5)] == order and all(abs(got[q][n][1] - c[q, i]) < 1e-12 for n, i in enumerate(order, 1))


def test_clusters_skip_most_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 25)
    skipped, all_ = vectors.skipped_share(frame(spark, clustered(400, 16, 16, 0.05)), 0.8)
    assert skipped > 0.6 * all_
    assert vectors.skipped_share(frame(spark, np.random.default_rng(2).normal(size=(100, 16))), 0.1)[0] >= 0


def test_few_and_none(spark):
    one = frame(spark, np.ones((1, 3)))
    assert vectors.similar_pairs(one, 0.5).count() == 0 and vectors.top_k(one, one.withColumnRenamed("id", "query"), 2).count() == 0
    for parts in (None, 3):
        assert vectors.similar_pairs(one.limit(0), 0.5, parts).count() == 0
        assert vectors.top_k(one.limit(0), one.withColumnRenamed("id", "query"), 2, parts).count() == 0


def test_rows_go_to_few_blocks_however_many_there_are(spark, monkeypatch):
    """What is shuffled is a row times its blocks, so their number is bounded."""
    monkeypatch.setattr(vectors, "BLOCK", 4)
    monkeypatch.setattr(vectors, "SLICE", 500)
    x = clustered(400, 6, 9, 1.5)
    rows, c = frame(spark, x), cosines(x)
    blocks, size = vectors._sizes(rows)
    assert (blocks, size) == (vectors.MOST_BLOCKS, 25)
    got = {(r["a"], r["b"]) for r in vectors.similar_pairs(rows, 0.7).collect()}
    assert got == {(a, b) for a, b in np.argwhere(c >= 0.7) if a < b}
    best = {(r["query"], r["rank"]): r["id"] for r in vectors.top_k(rows, rows.withColumnRenamed("id", "query"), 3).collect()}
    for q in range(400):
        order = [i for i in np.lexsort((np.arange(400), -np.round(c[q], 9))) if i != q][:3]
        assert [best[q, n] for n in (1, 2, 3)] == order


def test_vectors_are_sent_in_few_bytes(spark):
    """Each number keeps its value; counts take a byte or two, single precision four."""
    rows = [[1.0, -127.0], [300.0, 0.0], [0.5, float(np.float32(0.1))], [0.1, 1e300], [float("nan"), 1.0]]
    packed = vectors._packed(pa.array(rows, pa.list_(pa.float64())))
    assert [len(v) for v in packed.to_pylist()] == [3, 5, 9, 17, 17]
    assert np.array_equal(vectors._unpacked(packed), np.array(rows), equal_nan=True)
    counts = np.random.default_rng(4).integers(-9, 9, (400, 256)).astype(float)
    placed, _ = vectors._placed(frame(spark, counts), 4, 100)
    assert max(len(r["v"]) for r in placed.select("v").collect()) == 257


def test_tasks_take_groups_of_blocks(spark, monkeypatch):
    """However many blocks and pivots there are, a row is sent to as many tasks as there are groups, and these are even."""
    monkeypatch.setattr(vectors, "BLOCK", 4)
    x = clustered(400, 6, 9, 1.5)
    rows, c = frame(spark, x), cosines(x)
    placed, places = vectors._placed(rows, *vectors._sizes(rows))
    held = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert places.blocks.sum() >= 16 and len(held) == vectors.GROUPS and max(held) < 3 * min(held)
    got = {(r["a"], r["b"]) for r in vectors.similar_pairs(rows, 0.5).collect()}
    assert got == {(a, b) for a, b in np.argwhere(c >= 0.5) if a < b}
    monkeypatch.setattr(vectors, "MOST_VALUES", 6 * 40)  # more groups where they would hold too much
    assert len({g for gs in places.groups(16) for g in gs}) == 10


def test_units_keep_what_was_sent():
    """A task holds counts as bytes; unit vectors are the same as from doubles."""
    counts = np.random.default_rng(5).integers(-9, 9, (50, 8)).astype(float)
    counts[3] = 0
    units = vectors.Units(vectors._packed(pa.array(counts.tolist(), pa.list_(pa.float64()))))
    assert units.numbers.dtype == np.int8 and np.array_equal(units.double(), counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-300))
