"""Tiles of sketches against all pairs of a block, in many small tiles and one large one."""

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.operators import likeness


def side(seed, n, first=0):
    """Sketches of random bits, of two buckets and all sizes; about half are near copies of the one before."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        if rows and rng.random() < 0.5:
            size, bucket, old = rows[-1][2], rows[-1][1], bytearray(rows[-1][3])
            for at in rng.integers(0, len(old), size // 12):
                old[at] ^= 1
            sketch = bytes(old)
        else:
            size, bucket = int(rng.choice([1, 20, 150, 400, 420, 3000])), str(rng.choice(["x", "y"]))
            sketch = rng.bytes(8 * int(likeness._words(np.array([size]), 85)[0]))
        rows.append((first + i, bucket, size, sketch, int(rng.integers(1, 3))))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int32()), strict=True)], names=["id", "bucket", "n", "sketch", "role"])


def apart(p, q):
    x, y = (np.frombuffer(r["sketch"], np.uint64) for r in (p, q))
    while len(x) != len(y):
        x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
    return int(np.bitwise_count(x ^ y).sum())


def alike(p, q):
    close = 85 * max(p["n"], q["n"]) <= 100 * min(p["n"], q["n"])
    return p["bucket"] == q["bucket"] and close and apart(p, q) <= 15 * (p["n"] + q["n"]) // 185


@pytest.mark.parametrize("tile", [(3, 5), (128, 512)])
def test_tiles_find_what_all_pairs_do(monkeypatch, tile):
    monkeypatch.setattr(likeness, "TILE", tile)
    codes, one, other = {"x": 0, "y": 1}, side(1, 160), side(2, 120, 1000)
    p, q = one.to_pylist(), other.to_pylist()
    mixed = one.take(pa.array(np.random.default_rng(3).permutation(160)))  # the rows of a block come in any order
    x, turned, y = (likeness._Side(t, codes, 85) for t in (one, mixed, other))
    found = [sorted((int(x.id[i]), int(turned.id[j]))) for a, b in likeness._alike(x, turned, 85, (0, 0), True) for i, j in zip(a, b, strict=True)]
    want = [[a["id"], b["id"]] for k, a in enumerate(p) for b in p[k + 1 :] if alike(a, b)]
    assert sorted(found) == want and len(want) > 40
    across = [(int(x.id[i]), int(y.id[j])) for a, b in likeness._alike(x, y, 85, (1, 2)) for i, j in zip(a, b, strict=True)]
    assert sorted(across) == [(a["id"], b["id"]) for a in p for b in q if a["role"] == 1 and b["role"] == 2 and alike(a, b)]
