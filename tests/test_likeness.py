"""Sketches of sets: no pair of like sets is lost, unlike ones are ruled out without the sets."""

import random

import pytest

from sparkloom.operators import likeness


def sets(seed, n, buckets):
    """(id, bucket, members): sets of very different sizes and near copies of some."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        size = rng.choice((1, 3, 9, 40, 200, 700))
        m = {f"w{rng.randrange(5 * size)}" for _ in range(size)}
        if rows and rng.random() < 0.5:
            m = set(rng.choice(rows)[2])
            for w in rng.sample(sorted(m), len(m) // rng.choice((3, 5, 8, 20))):
                m.discard(w)
                m |= {f"v{rng.randrange(900)}"} if rng.random() < 0.5 else set()
        rows.append((i, f"b{rng.randrange(buckets)}", m))
    return rows


def jaccard(x, y):
    return 100 * len(x & y), len(x | y)


@pytest.mark.parametrize(("buckets", "percent"), [(2, 80), (40, 85)])
def test_like_sets_are_all_found(spark, monkeypatch, buckets, percent):
    monkeypatch.setattr(likeness, "LEAST_ROWS", 25)  # many blocks
    rows = sets(buckets, 260, buckets)
    frame = spark.createDataFrame([(i, b, list(m)) for i, b, m in rows], "id long, bucket string, members array<string>")
    frame = frame.select("id", "bucket", likeness.hashed(frame["members"], "array<string>").alias("members"))
    placed, cells = likeness.placed(likeness.sketched(frame, percent), percent)
    pairs = likeness.candidates(placed, cells, percent)
    maybe = [(r["a"], r["b"]) for r in pairs.collect()]
    want = {}
    for k, (i, b, m) in enumerate(rows):
        for j, c, o in rows[k + 1 :]:
            both, either = jaccard(m, o)
            if b == c and both >= percent * either:
                want[i, j] = (both // 100, len(m), len(o))
    assert len(maybe) == len(set(maybe)) and want and set(want) <= set(maybe) and len(maybe) < 3 * len(want) + 60
    assert {(r["a"], r["b"]): (r["common"], r["na"], r["nb"]) for r in likeness.confirmed(pairs, frame, percent).collect()} == want
    before = {b for _, b in maybe}
    assert {r["id"] for r in likeness.behind(placed, cells, percent).collect()} == before


def test_strings_are_sets_of_their_windows(spark):
    rows = [(1, "b", "abcdefghij" * 3), (2, "b", "abcdefghij" * 4), (3, "b", "xyz"), (4, "b", "xyz"), (5, "b", "\U0001f600bcd" * 2), (6, "b", None), (7, "b", "")]
    frame = spark.createDataFrame(rows, "id long, bucket string, members string")
    found = {r["id"]: r for r in likeness.sketched(frame, 85).collect()}
    assert {i: r["n"] for i, r in found.items()} == {1: 10, 2: 10, 3: 1, 4: 1, 5: 4, 6: 0, 7: 0}
    assert found[1]["kind"] == found[2]["kind"] != found[5]["kind"] and found[3]["kind"] == found[4]["kind"]


def test_unlike_texts_of_common_words_are_not_sent(spark):
    """Texts of the same few words in one language and source: by shared words each would meet each, by sketches none do."""
    rng, words = random.Random(3), [f"w{k}" for k in range(400)]
    rows = [(i, "b", rng.sample(words, 120)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, bucket string, members array<string>")
    frame = frame.select("id", "bucket", likeness.hashed(frame["members"], "array<string>").alias("members"))
    assert likeness.candidates(*likeness.placed(likeness.sketched(frame, 80), 80), 80).count() == 0
