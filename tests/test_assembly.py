"""Nulls, ties, caps and empty tables in the assembly operators."""

from pyspark.sql import functions as F

from marlspring.operators import assembly as A


def test_skip_rule_reads_spellings(spark):
    rows = spark.createDataFrame([(1, " YES ", None), (2, None, "False"), (3, "no", "yes"), (4, None, None), (5, "perhaps", "0")], "id int, s string, c string")
    got = {r.id: r.x for r in rows.select("id", A.skipped(F.col("s"), F.col("c")).alias("x")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert A.coverage(rows.where("id > 9"), F.lit(False), []).first().coverage_rate == 0.0


def test_select_chunks_fills_up_without_references(spark):
    rows = [(1, 0, "aa", 0, False), (1, 1, "bbb", 5, True), (1, 2, "refs", 0, True), (1, 3, "cc", 0, False), (1, 4, "  ", 9, False), (1, 5, "dddd", -1, False)]
    rows += [(2, i, "x" * (i + 1), 1, False) for i in range(6)]
    d = spark.createDataFrame(rows, "doc int, i int, c string, s int, r boolean")
    got = A.select_chunks(d, "doc", "i", "c", F.col("s"), F.col("r"), 4).collect()
    assert sorted((r.doc, r.i) for r in got) == [(1, 0), (1, 1), (1, 3), (2, 2), (2, 3), (2, 4), (2, 5)]
    assert A.select_chunks(d.where("doc > 5"), "doc", "i", "c", F.col("s"), F.col("r"), 4).count() == 0


def test_missing_report_lists_the_first(spark):
    q = spark.createDataFrame([(i,) for i in range(12)], "qid int")
    run = spark.createDataFrame([("a", i) for i in range(2, 12)], "method string, qid int")
    got = {r.method: (r.n_missing, r.preview) for r in A.missing_report(q, run, q, ["a", "b"]).collect()}
    assert got == {"a": (2, "0, 1"), "b": (12, "0, 1, 2, 3, 4, 5, 6, 7...")}


def test_uploads_point_to_the_first_copy(spark):
    f = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, "x")], "id int, t string")
    got = {r.id: (r.state, r.parent) for r in A.uploads(f, "id", "t").collect()}
    assert got == {1: ("canonical", None), 2: ("canonical", None), 3: ("child", 1), 4: ("invalid", None), 5: ("child", 1)}


def test_score_names_errors_and_confidence(spark):
    d = spark.createDataFrame([(1, "n", None), (2, None, "c"), (3, " ", "")], "k int, name string, control string")
    items = spark.createDataFrame([(1, "projected", "a"), (1, "projected", "b"), (1, "raw", "x"), (1, "raw", "y"), (1, "raw", "z"), (2, "raw", "x"), (2, "raw", None)], "k int, kind string, item string")
    gold = spark.createDataFrame([("a", 4)], "item string, n long")
    got = {r.k: r.score for r in A.prediction_score(d, items, gold, "k").collect()}
    assert got == {1: 4 + 1 + 2 + 2, 2: 2 + 1 + 3, 3: 0}
    n = spark.createDataFrame([("a; b", "a"), ("a", None), (None, ""), ("a", "b")], "p string, g string")
    assert [r.x for r in n.select(A.name_issue(F.col("p"), F.col("g")).alias("x")).collect()] == ["multi_sample_or_scope_mismatch", "gold_empty_policy_vs_predicted_name", "no_issue", "naming_convention_mismatch"]
    c = spark.createDataFrame([('{"a": {"x": 1}, "b": []}',), ('{"a": "t", "error": "e"}',), (None,), ("not json",)], "j string")
    assert [round(r.x, 4) for r in c.select(A.analysis_confidence(F.col("j"), ["a", "b"]).alias("x")).collect()] == [0.6, 0.1667, 0.3667, 0.3667]


def test_predictions_keep_order_and_caps(spark):
    a = spark.createDataFrame([(1, "x", 3), (1, "y", 1), (1, "x", 0), (1, None, 0), (2, "z", 0)], "doc int, item string, n int")
    b = spark.createDataFrame([(2, "p", 1), (2, "q", 0)], "doc int, item string, n int")
    got = {r.doc: (r.a, r.b) for r in A.predictions_by_document({"a": a, "b": b}, "doc", "item", "n", {"a": 3, "b": 1}).collect()}
    assert got == {1: ("x; y", ""), 2: ("z", "q")}
