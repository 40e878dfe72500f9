"""Pairs of texts whose cosine is a threshold to the last bit, against SQL."""

import duckdb
import pytest

from sparkloom import catalog
from sparkloom.operators import vectors

#: Of each pair a seed, its shingles and how many differ, chosen so that a product of rounded unit vectors falls below.
TIES = {0.88: (106, 75, 9), 0.9: (0, 20, 2), 0.95: (0, 60, 3)}


def pair(seed, n, apart):
    words = [f"a{seed}x{i}" for i in range(n + 2)]
    return " ".join(words), " ".join(words[:-apart] + [f"b{seed}x{i}" for i in range(apart)])


@pytest.mark.parametrize("name", ["canonical_dedup", "merge_layer", "merge_report"])
def test_texts_at_a_threshold(spark, tmp_path, name):
    texts = [t for tie in TIES.values() for t in pair(*tie)]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).select(*names).collect())) == sorted(found.fetchall())


def test_whole_numbers_meet_their_threshold(spark):
    rows = [(i, [1.0] * 22 + [float(i == 0)] * 3 + [float(i == 1)] * 3) for i in range(2)] + [(2, [1e-100] * 28), (3, [1e-100] * 28), (4, [0.0] * 28)]
    scores = {(r["a"], r["b"]): r["score"] for r in vectors.similar_pairs(spark.createDataFrame(rows, "id long, v array<double>"), 0.88).collect()}
    assert scores[0, 1] == 0.88 and set(scores) == {(a, b) for b in range(4) for a in range(b)} and abs(scores[2, 3] - 1) < 1e-12
