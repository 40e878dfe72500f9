"""The corpus pipeline end to end on a small table with planted rows."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from sparkloom.llm import packing, queries

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    benchmark = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    good = next(r["text"] for r in rows if len(r["text"]) > 1500 and not re.search(r"[#*!@]", r["text"]) and not any(b["text"] in r["text"] for b in benchmark))
    fresh = lambda n: " ".join(w + str(n) if i % 3 == 0 else w for i, w in enumerate(good.split(" ")))
    plant = {9000: fresh(1), 9001: fresh(1), 9002: fresh(2) + " " + benchmark[0]["text"], 9003: fresh(3) + " password = qwertz123456", 9004: "a b", 9005: fresh(4)}
    extra = [{"doc_id": i, "text": t, "lang": "en", "source": f"planted{i}", "n_chars": len(t)} for i, t in plant.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows + extra, schema)
    stages, out = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        assert set(out.columns) == set(docs.columns)
        out.write.parquet(str(tmp_path / name))
        out = stage(spark, spark.read.parquet(str(tmp_path / name)), SF)
        stages[name] = out
    ids = {n: Counter(r["doc_id"] for r in df.select("doc_id").collect()) for n, df in stages.items() if n != "packed"}
    assert 9004 not in ids["quality"] and set(plant) - {9004} <= set(ids["quality"])
    assert 9000 in ids["dedup"] and 9001 not in ids["dedup"]
    assert {9000, 9003, 9005} <= set(ids["decontaminated"]) and 9002 not in ids["decontaminated"]
    assert ids["secrets"] == ids["decontaminated"] and max(ids["secrets"].values()) == 1
    texts = {r["doc_id"]: r["text"] for r in stages["secrets"].collect()}
    assert texts[9003] == fresh(3) + " [SECRET]" and texts[9005] == plant[9005]
    encode = packing.encoder(queries.tokenizer_path())
    packed = stages["packed"].collect()
    want = {i: len(encode(t)) // 4 + 1 for i, t in texts.items()}
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == Counter(want)
    used = Counter()
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and len(used) >= packing.lower_bound(np.array([r["length"] for r in packed]), 1024)


def test_pipeline_of_nothing(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_run_leaves_one_table(spark):
    import os

    import corpus_pipeline

    from sparkloom.sources.shared import shared_dir

    root = os.path.dirname(shared_dir(spark)).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = corpus_pipeline.run(spark, SF)
    assert out.where("piece = 0").count() > 0
    assert len(set(os.listdir(root)) - before) == 1
