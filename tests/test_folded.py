"""Folded products and digests made many at a time, against plain ones."""

import hashlib

import numpy as np
import pytest

from sparkloom.functions import digests
from sparkloom.operators import merge, vectors


@pytest.mark.parametrize("spread", [0.02, 0.2, 2.0])
def test_folded_pairs_equal_all_products(spark, monkeypatch, spread):
    monkeypatch.setattr(vectors, "BLOCK", 150)
    monkeypatch.setattr(vectors, "TILE", (16, 32))
    assert vectors._kept(256, 0.88) and not vectors._kept(64, 0.8)
    rng = np.random.default_rng(3)
    x = np.rint(20 * (rng.normal(size=(9, 256))[rng.integers(0, 9, 400)] + spread * rng.normal(size=(400, 256))))
    x[5] = 0
    got = {(r["a"], r["b"]) for r in vectors.similar_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), 0.88).collect()}
    squares = (x * x).sum(axis=1)
    cosines = x @ x.T / np.maximum(np.sqrt(np.outer(squares, squares)), 1)
    assert got == {(a, b) for a, b in np.argwhere(cosines >= 0.88).tolist() if a < b} and (spread > 1 or len(got) > 400)


def test_folded_products_bound_whole_ones():
    x = vectors.Units(vectors.pa.array(np.random.default_rng(4).normal(size=(80, 48)).tolist(), vectors.pa.list_(vectors.pa.float64())))
    assert (x.folded(9) @ x.folded(9).T >= x.double() @ x.double().T - 1e-6).all() and np.allclose((x.folded(9) ** 2).sum(axis=1), 1, atol=1e-6)


def test_md5_heads():
    rng = np.random.default_rng(5)
    parts = [rng.bytes(n) for n in [*range(70), 200, 0, 55, 56]]
    end = np.cumsum([len(p) for p in parts])
    got = digests.md5_heads(b"".join(parts), end - [len(p) for p in parts], end)
    assert got.tolist() == [int.from_bytes(hashlib.md5(p).digest()[:2], "little") for p in parts]


def test_text_vectors(spark, monkeypatch):
    monkeypatch.setattr(merge, "LOT", 50)
    texts = [None, "", " a b", "A\tb\x0bc d", "a b c\x1cd  e " + "x" * 60 + " É Éa", *[" ".join(f"w{i}" for i in range(n)) for n in range(1, 90, 7)]]
    got = {r["id"]: r["v"] for r in merge.text_vectors(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    for i, t in enumerate(texts):
        w, v = (t or "").lower().encode().split(), np.zeros(256, int)
        for s in zip(w, w[1:], w[2:]):
            d = hashlib.md5(b" ".join(s)).digest()
            v[d[0]] += 1 if d[1] < 128 else -1
        assert got.get(i, [0] * 256) == v.tolist()
