"""Rows that break careless code, through every corpus operator and every stage of the pipeline."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sparkloom.llm import chat_format, decontaminate, near_dedup, ngrams, packing, quality_classifier, quality_rules, queries, secret_scan, suffix_array, url_filter, warc

SF = "/root/testdata/sf0.001"
MILLION = 1_000_000


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    prose = " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(300))
    texts = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "x" * MILLION), (5, " " * (MILLION + MILLION // 5)), (6, "eyJ" * 300_000), (7, "ab" * 300_000), (8, prose), (8, prose), (9, prose), (None, prose), (10, "token: abcdef1234"), (11, "ﬁ \U0001f642 é" * 50)]
    rows = [(i, t, "en", f"s{n % 3}" if n % 4 else None, 0, 1, "k", 2, 3, "a", "b", 4, 5, "h", 6, [7]) for n, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, key string, `a.b` int, `spans` int, `bytes` string, `x``y` string, Quality int, `__row` long, `__h` string, `__id` int, `set` array<int>"
    return spark.createDataFrame(rows, schema).repartition(3)


def ids(df, key="doc_id"):
    return Counter(r[key] for r in df.select(key).collect())


def test_operators_on_odd_rows(spark, odd):
    want = ids(odd)
    base = ["doc_id", "text", "source", "id", "key", "a.b"]
    docs = odd.select(*[f"`{c}`" for c in base])
    pieces = packing.pack_documents(docs, queries.tokenizer_path()).where("piece = 0")
    assert ids(pieces) == want
    assert ids(suffix_array.remove_repeats(docs)) == want
    near = near_dedup.near_duplicates(docs).collect()
    assert Counter(r["doc_id"] for r in near) == want and {r["component_id"] for r in near if r["doc_id"] in (8, 9)} == {8}
    benchmark = spark.createDataFrame([(None, "zz" * 40), (5, " " * 400), (6, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(5, 5)}
    began = time.perf_counter()
    assert ids(secret_scan.scan_secrets(docs)) == want and time.perf_counter() - began < 60
    scored = quality_rules.measure_and_score(docs, quality_rules.Regression(np.zeros(ngrams.BUCKETS, dtype=np.float32), 1.0, 1.0, 0.0))
    assert ids(scored) == want
    model = quality_classifier.NBSVM(np.zeros(ngrams.BUCKETS, dtype=np.float32), 0.5, 1.0, 0.0)
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.score_texts(docs, model).collect())


def test_pages_and_chats_on_odd_rows(spark, odd):
    pages = odd.selectExpr("doc_id AS page_id", "text AS url", "text AS html", "`a.b`", "key")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, action string")
    assert ids(url_filter.filter_urls(pages, rules), "page_id") == ids(odd)
    back = warc.archive_and_read(pages)
    assert back.count() == odd.count() and back.where("record_type = 'response'").count() == 9
    chats = odd.selectExpr("doc_id AS conv_id", "CAST(id AS long) AS turn", "'assistant' AS role", "text", "`a.b`", "key")
    read = {r["conv"]: r["loss_text"] for r in chat_format.read_back(chat_format.format_chats(chat_format.conversation_events(chats))).collect()}
    assert read[4] == "x" * MILLION and read[1] == "" and set(read) == set(ids(odd))


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    out = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns, name
        kept = ids(got)
        assert not kept - ids(odd)
        if name in ("secrets", "decontaminated"):
            assert kept == ids(odd)
        if name == "dedup":
            assert kept[8] == 1 and kept[9] == 0 and kept[3] == 1
        out = got
    assert next(r["text"] for r in corpus_pipeline.secrets(spark, odd, SF).where("doc_id = 10").collect()) == "[SECRET]"
    assert ids(corpus_pipeline.packed(spark, out, SF).where("piece = 0")) == ids(out)


def test_of_rows_alike_the_least_stays(spark):
    rows = [(1, "a b c d e f", "z", {"k": 1}), (1, "a b c d e f", "y", {"k": 2}), (None, "g h i j k l", "z", {}), (None, "g h i j k l", "x", {}), (2, None, "z", {}), (2, "m n", "q", {})]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, note string, more map<string,int>").repartition(parts)
        assert sorted(near_dedup.keep_first(docs).select("note").toPandas()["note"]) == ["q", "x", "y", "z"]


def test_thue_morse_words(spark):
    """Words whose sums of powers modulo 2**64 agree for every base are different words all the same."""
    a, b = ("".join(f"{thue_morse(2048, s)}{k} " for k in range(12)) for s in (False, True))
    rows = near_dedup.near_duplicates(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in rows} == {1, 2}
    w, v = thue_morse(2048), thue_morse(2048, True)
    text = " ".join([*[w + x for x in "cdefg"], *[v + x for x in "cdefg"], "end"])
    assert quality_rules.measures(text)[4] == 0 and quality_rules.measures(text + " " + text)[4] == 22


def test_fold_ties_and_repeats(spark):
    def fold(*events):
        frame = spark.createDataFrame([(1, s, 1, k, "user", t) for s, k, t in events], "conv long, seq long, message long, kind string, role string, text string")
        return [r["text"] for r in chat_format.fold_messages(frame).collect()]

    assert fold((1, "delta", "x"), (1, "edit", "y")) == ["y"]
    assert fold((1, "delta", "x"), (2, "edit", "Hi"), (2, "edit", "Hi")) == ["Hi"]
    assert fold((1, "delta", "x"), (2, "delete", None), (2, "delete", None)) == []
    assert fold((1, "delta", "x"), (2, "delete", None), (3, "delta", "a"), (3, "delta", "a")) == ["aa"]


def test_chat_events_run_through_the_fold(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "a b c"), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    log = chat_format.conversation_events(rows)
    assert Counter(r["kind"] for r in log.collect()) == {"delta": 5, "edit": 1, "regenerate": 2}
    assert [(r["role"], r["text"]) for r in chat_format.fold_messages(log).orderBy("message").collect()] == [("user", "hello"), ("assistant", "a b c"), ("assistant", "")]


def test_exchange_between_partitions(spark):
    """Partitions of odd lengths leave gaps, and the exchange closes some of them; offsets stay gapless."""
    rng = random.Random(8)
    lengths = [rng.choice([340, 345, 350, 520, 170, 1023, 1024]) for _ in range(600)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    alone = packing.pack(items, per_partition=60, rounds=1)
    exchanged = packing.pack(items, per_partition=60, rounds=4).join(items, "item").collect()
    assert len({r["sequence_id"] for r in exchanged}) <= alone.select("sequence_id").distinct().count()
    bins = {}
    for r in exchanged:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["part_bound"] <= r["part_bins"]
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(exchanged) == 600 and packing.lower_bound(np.array(lengths), 1024) <= len(bins)
    assert {(r["run_bins"], r["run_bound"]) for r in exchanged} == {(len(bins), packing.lower_bound(np.array(lengths), 1024))}


def test_bins_completed_one_by_one():
    rng = np.random.default_rng(6)
    for _ in range(40):
        lengths = rng.integers(1, 101, size=rng.integers(1, 90))
        bins, offsets, rooms = packing.complete_bins(lengths, 100, int(rng.integers(0, 9)))
        for b in range(len(rooms)):
            at = np.flatnonzero(bins == b)
            at = at[np.argsort(offsets[at])]
            assert len(at) and list(offsets[at]) == [0, *np.cumsum(lengths[at])[:-1]] and lengths[at].sum() == 100 - rooms[b]
        assert packing.lower_bound(lengths, 100) <= len(rooms)
    # 50 + 30 + 20 and 30 + 25 + 25 + 20, where the best fit puts 30 + 30 and 25 + 25 together
    assert len(packing.complete_bins(np.array([50, 30, 30, 20, 20, 25, 25]), 100)[2]) == 2


def test_the_exchange_meets_the_bound_of_the_whole(spark):
    """Seven partitions lose a part of a bin each; the exchange brings them back."""
    lengths = np.random.default_rng(5).integers(1, 700, size=700)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item long, length long")
    alone = packing.pack(items, per_partition=100, rounds=1).select("sequence_id").distinct().count()
    row = packing.pack(items, per_partition=100).first()
    assert row["run_bound"] == packing.lower_bound(lengths, 1024) and row["run_bins"] <= row["run_bound"] + 1 < alone


def test_frequent_grams_count_like_rare_ones(monkeypatch):
    rng = random.Random(6)
    part = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    items = [(str(i), part(40) + rng.choice([" ", "ab"]) * 60 + part(40)) for i in range(12)] + [(None, "q" * 30), ("s", " " * 80)]
    index = decontaminate.ItemIndex(items)
    for n in range(12):
        planted = list(items[n][1])
        for _ in range(3):
            planted[rng.randrange(len(planted))] = "z"
        text = part(100) + " " * 500 + "".join(planted) + "ab" * 300
        monkeypatch.setattr(decontaminate, "MOST_PAIRS", 1 << 21)
        plain = index.matches(text), index.bands(decontaminate.normalized(text))
        monkeypatch.setattr(decontaminate, "MOST_PAIRS", 50)
        assert (index.matches(text), index.bands(decontaminate.normalized(text))) == plain
        assert items[n][0] in [m[0] for m in plain[0]]
        monkeypatch.setattr(decontaminate, "MOST_DIAGONALS", 200)
        assert index.matches(text) == plain[0]


def test_decontamination_with_string_ids(spark):
    docs = spark.createDataFrame([(1, "say " + "h" * 20 + " and " + "k" * 20)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "h" * 20), (None, "k" * 20), ("a", "h" * 20)], "item_id string, text string")
    assert sorted((r["item_id"] or "") for r in decontaminate.contaminated(docs, items).collect()) == ["", "a"]


def test_segments_halved_by_shared_context(spark):
    """A passage in many contexts, some of which repeat."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage, context = word(150), [word(100) for _ in range(6)]
    texts = [rng.choice(context)[rng.randrange(60) :] + passage + rng.choice(context)[: rng.randrange(100)] for _ in range(150)]
    from test_corpus_operators import brute_removed

    want = sorted(x[:3] for x in brute_removed([t.encode() for t in texts], 200))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (2, 10, 10**6):
        got = [(r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"])) for r in suffix_array.remove_repeats(frame, hot=hot).collect()]
        assert sorted(got) == want


def test_ratios_and_descent_against_plain_python(spark):
    texts = [("good words here " * n, 1) for n in range(1, 9)] + [("bad #### stuff", 0), ("worse ####", 0), (None, 0), ("", 1)]
    labelled = spark.createDataFrame(texts, "text string, label int")
    ratios, n0, n1 = quality_classifier.log_count_ratios(labelled)
    counts = {0: [1.0] * ngrams.BUCKETS, 1: [1.0] * ngrams.BUCKETS}
    for text, label in texts:
        for at in ngrams.indicators(text):
            counts[label][at] += 1
    total = {c: sum(v) for c, v in counts.items()}
    want = [np.log(p / total[1]) - np.log(q / total[0]) for p, q in zip(counts[1], counts[0], strict=True)]
    assert (n0, n1) == (3, 9) and np.allclose(ratios, want)
    # The dual objective's optimum: no single coordinate can improve it.
    rows = [ngrams.indicators(t) for t, _ in texts]
    y = np.array([1 if label else -1 for _, label in texts])
    w, bias = quality_classifier.dual_coordinate_descent(rows, y, ratios, epochs=200)
    x = np.zeros((len(rows), ngrams.BUCKETS))
    for i, at in enumerate(rows):
        x[i, at] = ratios[at] / max(np.sqrt(len(at)), 1.0)
    alpha, plain, b = np.zeros(len(rows)), np.zeros(ngrams.BUCKETS), 0.0
    for _ in range(400):
        for i in range(len(rows)):
            new = min(max(alpha[i] - (y[i] * (plain @ x[i] + b) - 1) / (x[i] @ x[i] + 1), 0), 1)
            plain, b, alpha[i] = plain + (new - alpha[i]) * y[i] * x[i], b + (new - alpha[i]) * y[i], new
    assert np.allclose(x @ plain + b, [quality_classifier.NBSVM(w, bias, 1, 0).margin(at) for at in rows], atol=1e-2)


def test_regression_and_calibration():
    rng = np.random.default_rng(5)
    scores = rng.normal(size=4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-(2 * scores - 1)))).astype(int)
    a, b = ngrams.platt(scores, labels)
    assert abs(a - 2) < 0.25 and abs(b + 1) < 0.25
    rows = []
    for n in range(400):
        at, v = ngrams.frequencies(("clean prose number " if n % 3 else "#### $$$$ ") + str(n))
        rows.append((at.tobytes(), v.astype(np.float32).tobytes(), int(n % 3 > 0)))
    model = quality_rules.fit(rows, 60)
    assert model.score("clean prose number x") > 0.8 > 0.4 > model.score("#### $$$$ x")


def test_a_sample_is_bounded():
    """Repeated rows do not enlarge what a model is fitted to."""
    batch = lambda: iter([pa.record_batch([pa.array([b"x" * 40] * 100), pa.array(range(100))], names=["at", "label"])])
    assert len(ngrams.bounded(batch(), 30)) == 30
    assert len(ngrams.bounded(batch(), 100, 400)) == 10


def test_warc_headers(spark):
    import zlib

    pages = spark.createDataFrame([(1, "http://a.b/é", "x"), (1, "http://a.b/é", "x"), (2, "http://a.b/", "x"), (None, None, None)], "page_id long, url string, html string")
    data = b"".join(bytes(r["data"]) for r in warc.write_archive(pages).orderBy("block").collect())
    records = [zlib.decompress(data[a : a + n], 31) for a, n in warc.members(data, 50)]
    named = [re.search(rb"WARC-Record-ID: (<urn:uuid:[0-9a-f-]{36}>)\r\n", r)[1] for r in records]
    assert len(records) == len(set(named)) == 4 and all(b"\r\nWARC-Date: " in r and b"\r\n\r\nHTTP/1.1 200 OK\r\n" in r for r in records)
    for r in records:
        head, _, body = r.partition(b"\r\n\r\n")
        assert len(body) == int(re.search(rb"Content-Length: (\d+)", head)[1]) + 4
