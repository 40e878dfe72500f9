"""Functions and operators on small hand-made rows, beside the comparison of every query with SQL."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import identity, predicates, text, tokens
from sparkloom.operators import folds, graph, merge, relational, retrieval, views

L = F.lit


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c).first()[0]


def test_tokens(value):
    assert value(tokens.retrieval_tokens(L("The User 用户偏好 foo_bar x1 从 数据"))) == ["foo_bar", "x1", "从数", "偏好", "户偏"]
    assert value(tokens.query_tokens(L("数据流程 abcd efghij foo-bar-baz kk"))) == ["foo-bar-baz", "efghij", "abcd", "数据流程"]
    assert value(tokens.needles(L("src/app.py __init__ 你好吗 好 ab"))) == ["src/app.py", "init", "你好", "好吗", "好"]
    assert value(tokens.like_escaped(L("a\\b%c_d"))) == "a\\\\b\\%c\\_d"
    assert value(tokens.required_literals(L("Only answer if the evidence literally contains ABC-1, ok 仅当证据逐字包含校验码 X9。"))) == ["ABC-1", "X9"]
    assert value(F.round(tokens.pair_score(tokens.review_tokens(L("aa bb cc")), tokens.review_tokens(L("bb cc dd"))), 6)) == 0.52


@pytest.mark.parametrize(("said", "kind", "nod"), [("No, that is wrong", "corrected", False), ("it works great", "adopted", False), ("嗯嗯。", "none", True), ("ok!", "none", True), ("hello", "none", False), (" ", "none", True)])
def test_confirmations(value, said, kind, nod):
    assert value(tokens.confirmation(L(said))) == kind and value(tokens.short_confirmation(L(said))) == nod


@pytest.mark.parametrize(
    ("given", "want"),
    [("1700000000123", "2023-11-14T22:13:20.123Z"), ("1700000000000", "2023-11-14T22:13:20Z"), ("2024-01-02T03:04:05", "2024-01-02T03:04:05Z"), ("2024-01-02T03:04:05.120+02:00", "2024-01-02T01:04:05.120Z"), ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05Z"), ("soon", "soon"), ("", None)],
)
def test_times(value, given, want):
    assert value(identity.utc_time(L(given))) == want


def test_json(value):
    mixed = L('{"b": 1, "a": [1, {"z": 2, "y": null}]}')
    assert value(identity.canonical_json(mixed)) == '{"a":[1,{"y":null,"z":2}],"b":1}'
    assert value(identity.canonical_json(L("no"))) is None and value(identity.json_list(L("no"))) == ["no"]
    assert value(identity.json_list(L('[1,"x"]'))) == ["1", '"x"'] and value(identity.json_list(L("3"))) == ["3"] and value(identity.json_list(L(""))) == []
    assert value(identity.mended_json(L(r'{"p": "C:\dir"}'))) == r'{"p":"C:\\dir"}'


def test_checks(value):
    assert [value(identity.luhn(L(x))) for x in ("4111111111111111", "4111111111111112", "411")] == [True, False, False]
    keys = ["project:x", "goal:a:b:c", "goal:a:b", "subject: x", "project:a%2Fb", "project:a%20b", "decision:%zz", "zzz:1", "project:a%2525"]
    assert [value(identity.topic_key(L(k))) for k in keys] == ["project:x", "goal:a:b:c", None, None, None, "project:a b", None, None, None]
    assert value(predicates.is_noise(L("a4910d283097d12b"))) and not value(predicates.is_noise(L("guitar")))
    assert value(predicates.is_project_name(L("loom."))) and not value(predicates.is_project_name(L("skill_12")))
    assert value(text.windows(L("a🙂bc"), 2)) == ["a🙂", "🙂b", "bc"] and value(text.char_grams(L("ab "))) == ["ab"]


def test_a_broken_chain_is_told(spark):
    good = [(1, 1, "a", "genesis"), (1, 2, "b", "a"), (1, 3, "c", "b")]
    gap, forged = [(2, 1, "a", "genesis"), (2, 3, "c", "a")], [(3, 1, "a", "genesis"), (3, 2, "b", "x")]
    rows = folds.verify_chain(spark.createDataFrame(good + gap + forged, "chain long, seq long, checksum string, previous string")).collect()
    assert {r["chain"]: (r["first_fault"], r["fault"]) for r in rows} == {1: (None, None), 2: (3, "event_sequence_invalid"), 3: (2, "event_chain_mismatch")}


def test_cooldown_counts_from_what_was_shown(spark):
    start = datetime.datetime(2024, 1, 1)
    hours = [0, 20, 24, 40, 47, 48, 100]
    rows = spark.createDataFrame([("k", start + datetime.timedelta(hours=h), h) for h in hours], "key string, at timestamp_ntz, id long")
    assert [r["id"] for r in folds.surfaced(rows, 24).where("shown").orderBy("id").collect()] == [0, 24, 48, 100]


def test_decisions(spark):
    moves = [("confirmation", "defer"), ("action", "planned"), ("confirmation", "accept"), ("action", "planned"), ("confirmation", "revoke_before_action"), ("action", "started"), ("action", "completed"), ("action", "started")]
    log = spark.createDataFrame([(1, n, k, v) for n, (k, v) in enumerate(moves, 1)], "subject long, seq long, kind string, value string")
    got = [(r["confirmation"], r["action"], r["legal"]) for r in folds.decisions(log).orderBy("seq").collect()]
    assert got == [("deferred", None, True), ("deferred", None, False), ("accepted", None, True), ("accepted", "planned", True), ("accepted", "planned", False), ("accepted", "started", True), ("accepted", "completed", True), ("accepted", "completed", False)]


def test_controls(spark):
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    log = [(1, 1, t(1), "suppress", None, None), (2, 2, t(1), "suppress", None, None), (2, 3, t(2), "restore", None, 2), (3, 4, t(1), "snooze", t(2), None), (4, 5, t(1), "allow", None, None), (4, 6, t(1), "limit_scope", None, None), (5, 7, t(9), "suppress", None, None)]
    frame = spark.createDataFrame(log, "target long, event long, at timestamp_ntz, operation string, expires timestamp_ntz, undoes long")
    got = {r["target"]: (r["eligible"], r["reason"]) for r in folds.controls_as_of(frame, "2024-01-01 05:00:00").collect()}
    assert got == {1: (False, "suppressed_by_user"), 2: (True, None), 3: (True, None), 4: (False, "ambiguous_control"), 5: (True, None)}


def test_merge_levels(spark):
    base = " ".join(f"word{i}" for i in range(120))
    other = " ".join(f"thing{i}" for i in range(120))
    docs = [(1, base + " 17"), (2, base + " 18"), (3, base + " 19"), (4, other), (5, other), (6, base.replace("word7 ", "fresh ").replace("word70 ", "new ").replace("word100 ", "odd ")), (7, "alone")]
    rows = {r["id"]: r for r in merge.merge_layer(spark.createDataFrame(docs, "id long, text string")).collect()}
    assert {i: rows[i]["level"] for i in rows if i != 6} == {1: "same", 2: "same", 3: "same", 4: "topic", 5: "topic", 7: "none"}
    assert rows[6]["level"] in ("topic", "none")
    assert rows[2]["representative"] == 1 and rows[5]["representative"] == 4 and rows[7]["representative"] == 7


def test_reconcile(spark):
    units = [(1, "s", "k", "a b c d e f g", 1), (2, "s", "k", "a b c d e f g", 2), (3, "s", "k", "x y z", 3), (4, "s", "k", "p q r", 4), (5, "t", "k", "p q r", 5)]
    got = {r["id"]: (r["action"], r["peer"]) for r in merge.reconcile(spark.createDataFrame(units, "id long, subject string, kind string, answer string, created long")).collect()}
    assert got == {1: ("mark_superseded", 2), 2: ("keep_current", None), 3: ("mark_conflict", 4), 4: ("mark_conflict", 3), 5: ("noop", None)}


def test_views_of_odd_conversations(spark):
    rows = [(1, 0, "assistant", "hello there"), (1, 1, "user", "take up hello word"), (1, 2, "assistant", "hello again word"), (2, 0, "user", None), (3, 0, "user", "A sentence that both hold. x")] + [(4, 0, "user", "y. A sentence that both hold")]
    events = views.conversation_graph(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = {r["session"]: r for r in views.turn_views(events).collect()}
    assert len(turns[1]["members"]) == 2 and 2 not in turns
    episodes = {r["session"]: (len(r["members"]), r["fidelity"]) for r in views.episode_views(events).collect()}
    assert episodes[1] == (3, "CCCCCCC") and episodes[2][1] == "CPCPPCC"
    assert [len(r["members"]) for r in views.cross_session_views(events).collect()] == [2]
    again = {r["view_id"] for r in views.turn_views(events).collect()}
    assert again == {r["view_id"] for r in views.turn_views(events.repartition(3)).collect()}


def test_shortest_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("x", "y")], "a string, b string")
    assert {r["id"]: (r["depth"], r["previous"]) for r in graph.shortest_paths(edges, "a", 3).collect()} == {"a": (0, None), "b": (1, "a"), "d": (1, "a"), "c": (2, "b"), "e": (3, "c")}


def test_ranks_over_ranges(spark):
    rows = [(g, i) for g, n in (("a", 90), (None, 7), ("b", 1)) for i in range(n)]
    got = relational.ranked(spark.createDataFrame(rows, "g string, i long").repartition(5), "g", "i").collect()
    assert sorted((str(r["g"]), r["rank"] - 1) for r in got) == sorted((str(g), i) for g, i in rows) and all(r["i"] == r["rank"] - 1 for r in got)


def test_bootstrap(spark):
    pairs = spark.createDataFrame([(i, i % 2) for i in range(20)], "i long, d long")
    r = retrieval.paired_bootstrap(pairs, 500).first()
    assert r["n"] == 20 and r["mean"] == 0.5 and 0.2 < r["low"] < 0.5 < r["high"] < 0.8
    assert retrieval.paired_bootstrap(pairs.limit(0)).count() == 0


def test_facts_meet_by_classes(spark, tmp_path):
    """Parts and suppliers meet as classes of remainders, copies of an id count, and ids below 0 give what all pairs give."""
    import duckdb

    from sparkloom import catalog

    for name, parts, suppliers in (("a", [*range(0, 450), 7, 7], [*range(0, 1300, 7), 14]), ("b", [-151, -3, 0, 3, 49, 200], [-600, -53, 1, 3, 47, 650])):
        sf = tmp_path / name
        spark.createDataFrame([(i,) for i in parts], "p_partkey long").write.parquet(str(sf / "part.parquet"))
        spark.createDataFrame([(i,) for i in suppliers], "s_suppkey long").write.parquet(str(sf / "supplier.parquet"))
        con = duckdb.connect()
        for t in ("part", "supplier"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
        got = catalog.queries()["facts_lifecycle"](spark, str(sf)).select("fact", "state", "versions", "lifecycle")
        want = con.execute(f"SELECT fact, state, versions, lifecycle FROM ({catalog.oracle_sql()['facts_lifecycle']})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert name == "b" or "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_bootstrap_plan_holds_no_list_of_cases(spark):
    """The plan's size does not depend on the number of cases."""
    from sparkloom.operators import retrieval

    rows = retrieval.paired_bootstrap(spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 2).cast("int").alias("d")), draws=20)
    assert "ArrayData" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.first()["mean"] == 0.5


def test_common_neighbours_in_many_tasks(spark, monkeypatch):
    from sparkloom.operators import graph

    monkeypatch.setattr(graph, "BLOCK", 3)
    monkeypatch.setattr(graph, "TASK_PAIRS", 20)
    edges = {(a, b) for a in range(20) for b in range(9) if (a * b + a) % 4 < 2}
    found = graph.common_neighbours(spark.createDataFrame(sorted(edges) + [(0, 0)], "a long, b long"))
    want = {(x, y): n for x in range(20) for y in range(x + 1, 20) if (n := sum((x, b) in edges and (y, b) in edges for b in range(9)))}
    assert {(r["x"], r["y"]): r["n"] for r in found.collect()} == want
    assert graph.common_neighbours(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merge_layer_keeps_null_texts_and_asks_all_partners(spark):
    """Documents without a text are copies of each other; a member whose nearest partner is unlike asks the next ones."""
    base = " ".join(f"word{i}" for i in range(120))
    docs = [(1, None), (2, None), (3, "a b"), *((10 + i, f"{base} {i}") for i in range(6))]
    rows = {r["id"]: (r["level"], r["representative"], r["size"]) for r in merge.merge_layer(spark.createDataFrame(docs, "id long, text string")).collect()}
    assert rows == {1: ("same", 1, 2), 2: ("same", 1, 2), 3: ("none", 3, 1), **{10 + i: ("same", 10, 6) for i in range(6)}}
    likely = spark.createDataFrame([(i, 1, 1, 4) for i in (1, 2, 3, 4)] + [(5, 1, 5, 2), (6, 1, 5, 2)], "id long, copies long, cluster long, size long")
    said = spark.createDataFrame([(1, "first text of all"), (2, "first text of all."), (3, "zzzz yyyy"), (4, "zzzz yyyy."), (5, "qqqq"), (6, "wwww")], "id long, text string")
    pairs = spark.createDataFrame([(1, 3, 0.99), (1, 2, 0.98), (2, 3, 0.99), (3, 4, 0.98), (2, 4, 0.99), (5, 6, 0.99)], "a long, b long, score double")
    assert [r["cluster"] for r in merge._without_partner(said, likely, pairs).collect()] == [5]
