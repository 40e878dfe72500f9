"""The vector operators against brute force, on given tables and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import hard_negatives, neighbours, queries, vectors, whitening
from tests.conftest import SF

EMBEDDINGS = "vec_id long, embedding array<double>, label int, row string, v int, `x` long"


def given(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.label for r in rows])


def made(spark, found):
    """found: (id, vector, label) rows, with columns named like those inside the operators."""
    return spark.createDataFrame([(i, v, label, "r", 1, 2) for i, v, label in found], EMBEDDINGS)


ODD = [(None, [1.0, 2.0, 3.0], 1), (900, None, 1), (901, [], 1), (902, [1.0, None, 2.0], 1), (903, [float("nan"), 1.0, 1.0], 1), (904, [1.0, float("inf"), 1.0], 1), (905, [1.0, 2.0], 1)]


def whitened(x, wanted):
    u = np.unique(x, axis=0)
    centred = u - u.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(u))
    e, v = e[::-1][:wanted], v[:, ::-1][:, :wanted]
    return (x - u.mean(axis=0)) @ v / np.sqrt(e), e / (centred**2).sum() * len(u), u


def test_whitening_equals_dense_decomposition(spark):
    ids, x, _ = given(spark)
    rows = queries.op11_embedding_whitening(spark, SF).toPandas()
    want, shares, u = whitened(np.floor(64 * x) + 1e6, 16)
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-9)
    assert np.allclose(rows.groupby("component").explained.first(), shares, rtol=1e-10)
    n = len(u)
    deviation = ((n * (np.floor(64 * x).astype(np.int64) + 10**6) - u.astype(np.int64).sum(axis=0)) ** 2).sum(axis=1)
    assert (rows[rows.component == 1].set_index("vec_id").loc[ids].deviation.to_numpy() == deviation).all()
    assert rows.identity_error.max() < 1e-10 and set(rows.n) == {n}


def dense(a):
    """A local stand-in for the distributed product, counting its calls."""
    calls = []

    def product(y):
        calls.append(1)
        t = a @ y
        return a.T @ t, float(t @ t)

    return product, calls


@pytest.mark.parametrize("spectrum", [[9, 9, 9, 4, 4, 1, 1, 1, 0, 0], [5] * 10, [1e4, 1e2, 1, 1, 1e-2, 1e-3, 0, 0, 0, 0], [3, 0, 0, 0, 0, 0, 0, 0, 0, 0]])
def test_bidiagonalisation_finds_repeated_and_missing_values(spectrum):
    rng = np.random.default_rng(3)
    left, right = np.linalg.qr(rng.normal(size=(60, 10)))[0], np.linalg.qr(rng.normal(size=(10, 10)))[0]
    a = left @ np.diag(np.array(spectrum, dtype=float)) @ right.T
    values, found = whitening._components(dense(a)[0], 10, 6, np.sqrt((a * a).sum()))
    want = [s for s in sorted(spectrum, reverse=True)[:6] if s > 0]
    assert np.allclose(values, want, rtol=1e-8)
    assert np.allclose(found.T @ found, np.eye(len(want)), atol=1e-10)
    assert np.allclose(a.T @ (a @ found), found * values**2, atol=1e-9 * max(spectrum) ** 2)


def test_bidiagonalisation_stops_when_converged():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(300, 200)))[0]
    p = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    s = 0.5 ** np.arange(200)
    product, calls = dense(q * s @ p.T)
    values, _ = whitening._components(product, 200, 4, np.sqrt((s * s).sum()))
    assert np.allclose(values, s[:4], rtol=1e-10) and len(calls) < 80


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    # The last dimension never varies, and rows repeat.
    found = [(i, [*rng.normal(size=3).tolist(), 7.0], 0) for i in range(40)]
    rows = made(spark, [*found, found[0], (None, found[1][1], 0), *ODD])
    out, model = whitening.whiten(rows)
    out = out.toPandas()
    assert model.n == 40 and len(model.variances) == 3 and len(out) == 42 * 3
    assert out.id.isna().sum() == 3 and (out.id == 0).sum() == 6 and model.identity_error < 1e-9
    assert whitening.whiten(made(spark, []))[0].count() == 0
    assert whitening.whiten(made(spark, [found[0], found[0]]))[0].count() == 0
    assert whitening.whiten(made(spark, ODD))[0].count() == 0  # one sound vector of each length: the shorter one is left, without variance


def test_whitening_deviation_beyond_a_long_is_null(spark):
    out, _ = whitening.whiten(made(spark, [(1, [1e17, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 2.0], 0)]))
    assert {r.id: r.deviation for r in out.where("component = 1").collect()}[1] is None


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    d[ids == q] = np.inf
    order = np.lexsort((ids, d))[:k]
    return ids[order], d


def test_neighbours_recall_and_scores(spark):
    ids, x, _ = given(spark)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = neighbours.nearest(rows, lambda id: id % 10 == 0, k=10).toPandas()
    hits = 0
    for q, part in found.groupby("query"):
        want, d = brute(ids, x, q, 10)
        assert list(part.sort_values("rank")["rank"]) == list(range(1, 11))
        assert np.allclose(part.score, [d[ids == v][0] for v in part.id], atol=1e-12)
        assert list(part.sort_values("rank").id) == list(part.sort_values(["score", "id"]).id)
        hits += len(set(want) & set(part.id))
    assert found["query"].nunique() == 50 and hits >= 0.9 * 500


def test_neighbours_over_several_cells_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(6)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 150, axis=0), rng.normal(size=(1, 8)) + 0.01 * rng.normal(size=(150, 8)), rng.normal(size=(300, 8))])
    ids = np.arange(600)
    found = neighbours.nearest(made(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x)]), lambda id: id % 20 == 0, k=10).toPandas()
    hits = 0
    for q, part in found.groupby("query"):
        want, d = brute(ids, x, q, 10)
        hits += len(set(want) & set(part.id))
        assert len(part) == 10
        if q < 150:  # copies: all at distance nought, the smallest ids first
            assert list(part.sort_values("rank").id) == list(want)
    assert found["query"].nunique() == 30 and hits >= 0.9 * 300


def test_neighbours_of_odd_rows(spark):
    few = [(0, [1.0, 0.0, 0.0], 0), (100, [0.0, 1.0, 0.0], 0), (3, [0.0, 0.0, 9.0], 0), (3, [50.0, 0.0, 0.0], 0), (7, [0.0, 0.0, 0.0], 0), *ODD]
    found = neighbours.nearest(made(spark, few), lambda id: id % 100 == 0).collect()
    # All candidates, if fewer; the id 3 counts by its least vector.
    assert sorted((r["query"], r["rank"], r.id) for r in found) == [(0, 1, 100), (0, 2, 3), (100, 1, 0), (100, 2, 3)]
    assert {(r["query"], r.id): r.score for r in found}[0, 3] == pytest.approx(np.sqrt(82))
    assert neighbours.nearest(made(spark, []), lambda id: id % 100 == 0).count() == 0
    assert neighbours.nearest(made(spark, few[:1]), lambda id: id % 100 == 0).count() == 0


def test_probes_start_with_the_own_bucket(spark):
    ids, x, _ = given(spark)
    index = neighbours.fit(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>"), 10)
    at = index.projected(x[:5])
    for i in range(5):
        found = neighbours.probes(index, 2, at[2, i], 0.5)
        assert found[0] == index.bucket(2, np.floor(at[2, i])) and len(set(found.tolist())) == len(found)
        assert len(neighbours.probes(index, 2, at[2, i], 1.0)) >= len(found)


def negatives(ids, labels, x, every, k=3, n_positives=5):
    out = []
    for a in np.flatnonzero(ids % every == 0):
        s = x.astype(object) @ x[a].astype(object)  # Python's integers, as percentages of a score may exceed a long
        order = [b for b in np.lexsort((ids, (-s).astype(np.int64))) if ids[b] != ids[a]]
        for p in [b for b in order if labels[b] == labels[a]][:n_positives]:
            fit = [b for b in order if labels[b] != labels[a] and 50 * s[p] <= 100 * s[b] <= 95 * s[p]][:k]
            out += [(ids[a], ids[p], r + 1, ids[b], s[p], s[b]) for r, b in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("values", [vectors.BLOCK_VALUES, 64])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, values):
    """Small integers make many ties; small blocks make many groups; one label holds a third of the rows."""
    monkeypatch.setattr(vectors, "BLOCK_VALUES", values)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 8)
    rng = np.random.default_rng(7)
    x, ids = rng.integers(-3, 9, size=(400, 4)), np.arange(400) - 17
    x[:5] = 0
    labels = np.where(rng.random(400) < 0.3, 1, rng.integers(0, 40, 400))
    rows = spark.createDataFrame([(int(i), int(label), v.tolist()) for i, label, v in zip(ids, labels, x)], "id long, label long, x array<long>")
    got = hard_negatives.hard_negatives(rows, rows.where("id % 10 = 0")).collect()
    assert sorted(tuple(r) for r in got) == negatives(ids, labels, x, 10)


def test_hard_negatives_beyond_exact_doubles(spark):
    rng = np.random.default_rng(8)
    x, ids, labels = rng.integers(-(2**29), 2**29, size=(60, 3)), np.arange(60), rng.integers(0, 3, 60)
    rows = spark.createDataFrame([(int(i), int(label), v.tolist()) for i, label, v in zip(ids, labels, x)], "id long, label long, x array<long>")
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(rows, rows.where("id % 5 = 0")).collect()) == negatives(ids, labels, x, 5)


def test_threshold_walk_stops_early():
    rng = np.random.default_rng(9)
    x = rng.integers(-9, 10, size=(2000, 3))
    x[1234] = (100, -100, 100)
    lists, anchor = hard_negatives.SortedLists(np.arange(2000), x), np.array([5, -4, 3])
    ids, scores = hard_negatives._best_of(lists, anchor, np.ones(2000, bool), 1)
    assert list(ids) == [1234] and list(scores) == [1200]
    met = 0
    for new, got, bound in lists.walk(anchor):
        unmet = np.setdiff1d(np.arange(2000), new)
        met += len(new)
        if len(new) and 1200 in got and bound < 1200:
            break
        assert len(unmet)
    assert met < 100


def test_hard_negatives_of_odd_rows(spark):
    few = [(0, [1.0, 1.0, 0.0], 4), (1, [1.0, 1.0, 0.5], 4), (2, [1.0, 0.5, 0.0], 5), (2, [9.0, 9.0, 9.0], 6), (3, [1.0, 0.4, 0.0], None), (4, [1e300, 0.0, 0.0], 5), *ODD]
    rows = hard_negatives.labelled_rows(made(spark, few))
    got = [tuple(r) for r in hard_negatives.hard_negatives(rows, rows.where("id % 50 = 0")).collect()]
    assert got == [(0, 1, 1, 2, 2 * 256 * 256, 256 * 256 + 256 * 128)]
    empty = hard_negatives.labelled_rows(made(spark, []))
    assert hard_negatives.hard_negatives(empty, empty).count() == 0


def test_hard_negatives_equal_sql(spark, duck):
    got = queries.op13_hard_negatives(spark, SF)
    want = duck.execute(queries.oracle_sql()["op13_hard_negatives"]).df()
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.itertuples(index=False, name=None))


def test_most_frequent_length(spark):
    rows = spark.createDataFrame([([1.0],), ([1.0, 2.0],), ([3.0, 4.0],), ([5.0],), (None,)], "embedding array<double>")
    assert vectors.usable(rows, "embedding").select(F.size("v")).distinct().collect()[0][0] == 1
