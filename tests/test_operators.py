"""Core operators on hand-made rows: edge cases that the driver's tables lack."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marlspring.operators import analytics as N
from marlspring.operators import catalog as K
from marlspring.operators import confidence as C
from marlspring.operators import evaluation as M
from marlspring.operators import normalize as E
from marlspring.operators import retrieval as R
from marlspring.operators import review as L
from marlspring.operators import text as T
from marlspring.operators import validation as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [(None, ""), ("", ""), ("a\x00b﻿c", "abc"), ("hyphen-\nated", "hyphenated"), ("a  \t b\r\n\r\n\r\n\r\nc ", "a b\n\nc"), (" x ", "x")])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, T.clean_text) == want


def test_clean_text_flat(spark):
    assert one(spark, "a\n\nb  c", lambda c: T.clean_text(c, False)) == "a b c"


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + k % 26) for k in range(6000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "   "), (5, "short")], "doc_id long, text string")
    rows = sorted(T.chunks(df).collect(), key=lambda r: (r.doc_id, r.chunk_index))
    assert [(r.doc_id, r.chunk_index, r.start_char, len(r.content)) for r in rows] == [(1, 0, 0, 2800), (1, 1, 2480, 2800), (1, 2, 4960, 1040), (5, 0, 0, 5)]
    assert all(text[r.start_char : r.start_char + len(r.content)] == r.content for r in rows[:3])


def test_references_end_a_document(spark):
    pages = [(1, 0, "body"), (1, 1, "x\nReferences\n[1] a"), (1, 2, "more refs"), (2, 0, "a line of text that mentions the References section in a long sentence"), (2, 1, "end")]
    df = spark.createDataFrame(pages, "doc_id long, chunk_index long, content string")
    assert {(r.doc_id, r.chunk_index) for r in T.drop_references(df).collect()} == {(1, 0), (1, 1), (2, 0), (2, 1)}


@pytest.mark.parametrize(("raw", "want"), [('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('say {"a": {"b": 2}} ok', '{"a": {"b": 2}}'), ("none", None), ("{broken", None)])
def test_json_part(spark, raw, want):
    assert one(spark, raw, T.json_part) == want


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid long, doc_id long, score double")


def test_fusion_branches(spark):
    v = hits(spark, [(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.1), (2, 1, 0.4)])
    k = hits(spark, [(1, 1, 4.0), (1, 4, 2.0), (1, 5, 0.5), (2, 2, 3.0)])
    s = {(r.qid, r.doc_id): r.score for r in R.fuse(v, k, 0.7).collect()}
    assert math.isclose(s[1, 1], 0.7 * 1.0 + 0.3 * 1.0)
    assert math.isclose(s[1, 2], 0.5) and s[1, 3] == 0.0
    assert math.isclose(s[1, 4], 1.5 / 3.5) and s[1, 5] == 0.5  # 1 or less stays raw
    assert s[2, 1] == 0.0 and s[2, 2] == 0.0  # range 0 counts as 1


def test_search_modes(spark):
    v, k = hits(spark, [(1, 1, 0.9), (1, 2, 0.5)]), hits(spark, [(1, 2, 4.0), (1, 3, 2.0)])
    first = lambda mode, **a: [r.doc_id for r in R.search(mode, v, k, 5, **a).orderBy("rank").collect()]
    assert first("bm25") == [2, 3] and first("dense") == [1, 2]
    assert first("nonsense") == first("hybrid_rerank") == first("hybrid", alpha=7.0)


def test_ranking_metrics(spark):
    run = spark.createDataFrame([("m", 1, 10, 1), ("m", 1, 10, 2), ("m", 1, 11, 3), ("m", 1, 12, 4), ("m", 2, 10, 1)], "method string, qid long, doc_id long, rank long")
    qrels = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (1, 13, 1), (2, 10, 0)], "qid long, doc_id long, relevance int")
    rows = {r.qid: r for r in M.ranking_metrics(run, qrels, 10).collect()}
    r = rows[1]
    ideal = 3 + 1 / math.log2(3) + 1 / 2
    assert math.isclose(r.recall, 2 / 3) and r.mrr == 0.5 and math.isclose(r.ndcg, (3 / math.log2(3) + 1 / 2) / ideal) and (r.judged, r.retrieved) == (2, 3)
    assert not rows[2].evaluable and rows[2].ndcg is None
    s = M.method_summary(M.ranking_metrics(run, qrels)).first()
    assert (s.queries, s.evaluable) == (2, 1) and math.isclose(s.recall, 2 / 3)


def test_set_and_exact_scores(spark):
    df = spark.createDataFrame([("f", ["a", "b"], ["b", "c"]), ("f", [], []), ("g", None, ["x"])], "field string, p array<string>, g array<string>")
    s = {r.field: r for r in M.set_scores(df, "k", "field", "p", "g").collect()}
    assert (s["f"].tp, s["f"].fp, s["f"].fn, s["f"].samples) == (1, 1, 1, 1) and s["g"].f1 == 0.0
    ex = spark.createDataFrame([("f", "a", "a"), ("f", "a", "b"), ("f", "", None), ("f", None, "c"), ("f", "d", " ")], "field string, p string, g string")
    e = M.exact_scores(ex, "field", "p", "g").first()
    assert (e.tp, e.fp, e.fn, e.samples) == (1, 2, 2, 4)


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([("m", k, float(k)) for k in range(30)], "m string, q long, v double")
    a, b = M.bootstrap(df, "m", "q", "v").first(), M.bootstrap(df.repartition(7), "m", "q", "v").first()
    assert a == b and a.lower < a.mean == 14.5 < a.upper


def test_mmr_keeps_the_quota(spark):
    rows = [Row(qid=1, doc_id=d, chunk_index=c, score=1.0 - 0.01 * c - 0.1 * d, embedding=[1.0, 0.0] if c < 3 else [0.0, 1.0]) for d in range(3) for c in range(4)]
    got = R.mmr(spark.createDataFrame(rows), k=5, per_doc=2).orderBy("pos").collect()
    assert (got[0].doc_id, got[0].chunk_index) == (0, 0) and got[1].chunk_index == 3
    assert len(got) == 5 and max(sum(g.doc_id == d for g in got) for d in range(3)) == 2


def test_confidence_of_one_hit(spark):
    df = spark.createDataFrame([(1, "a b", 1, 5, 0.5, "a text with 1 number.")], "qid long, question string, rank long, doc_id long, score double, content string")
    r = C.confidence(df).first()
    assert r.consistency == 0.5 and 0.05 <= r.overall <= 0.95


def test_citations(spark):
    df = spark.createDataFrame([(1, "a [s1]\nb [s2]", 2), (2, "a [s3]", 2), (3, "a [s1]\nb", 2), (4, "none", 2)], "qid long, answer string, n_sources int")
    assert {r.qid: r.valid for r in R.citations(df).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_paging_and_parameters(spark):
    df = spark.range(25)
    ids = lambda *a: [r.id for r in K.page(df, [F.col("id")], *a).collect()]
    assert ids(1, 10) == list(range(10)) and ids(99, 10) == list(range(20, 25)) and ids(0, 10) == list(range(10)) and len(ids(1, 1000)) == 25
    assert K.split_parameter(["a, b", "", "c"]) == ["a", "b", "c"] and K.split_parameter(None) == []


def test_chain_to_root(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, None)], "k long, p long")
    assert {r.k: r.root for r in K.root_of_chain(df, "k", "p").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_upsert_prefers_new_on_a_tie(spark):
    a, b = spark.createDataFrame([(1, 5, "old"), (2, 9, "old")], "k int, t int, v string"), spark.createDataFrame([(1, 5, "new"), (2, 3, "new"), (3, 1, "new")], "k int, t int, v string")
    assert {r.k: r.v for r in K.upsert(a, b, ["k"], "t").collect()} == {1: "new", 2: "old", 3: "new"}


@pytest.mark.parametrize(("raw", "want"), [(None, ""), (" N/A ", ""), ("{}", ""), ("a \n b", "a b")])
def test_plain(spark, raw, want):
    assert one(spark, raw, E.plain) == want


def test_phrases_and_distinct(spark):
    assert one(spark, "a, B;none，b", E.phrases) == ["a", "B", "b"]
    assert one(spark, ["a", "A", "b", "B", "c"], lambda c: E.distinct_ignoring_case(c, 2), "array<string>") == ["a", "b"]


def test_names(spark):
    f = lambda c: E.names(c, r"NWA \d+", {"murchison": "Murchison"})
    assert one(spark, "the NWA 123 and murchison", f) == "NWA 123; Murchison" and one(spark, "Short name", f) == "Short name"
    assert one(spark, "a very long title of many words by someone", f) == ""


def test_best_match_is_the_library_ratio(spark):
    from difflib import SequenceMatcher

    a = spark.createDataFrame([(1, "abcdef")], "k long, n string")
    b = spark.createDataFrame([(2, "abcxef"), (3, "abcdeg"), (4, "zzz")], "k long, n string")
    r = E.best_match(a, b, F.lit(1), "n", "k", 0.5).first()
    assert (r.new_key, r.old_key) == (1, 2) and math.isclose(r.ratio, SequenceMatcher(None, "abcdef", "abcxef").ratio())


def test_validation(spark):
    assert one(spark, '{"k": 1, "x": 22}', lambda c: V.answer_check(c, ["k"])) == "ok" and one(spark, "{}", lambda c: V.answer_check(c, ["k"])) == "too_short"
    assert one(spark, '{"other": "value"}', lambda c: V.answer_check(c, ["k"])) == "no_required_key" and one(spark, "not json at all", lambda c: V.answer_check(c, ["k"])) == "not_json"
    assert [one(spark, x, V.priority, "double") for x in (0.8, 0.6, 0.59)] == [3, 2, 1]


def test_review_states(spark):
    log = spark.createDataFrame([(1, 1, "submit"), (1, 2, "approve"), (1, 3, "approve"), (2, 1, "approve"), (3, 1, "submit"), (3, 2, "reject"), (3, 3, "restore")], "item long, t long, action string")
    assert {r.item: r.state for r in L.current_state(log, "item", ["t"]).collect()} == {1: "approved", 2: "approved", 3: "pending"}
    assert {(r.item, r.t) for r in L.illegal_transitions(log, "item", ["t"]).collect()} == {(1, 3), (2, 1)}


def test_attempt_gate(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b", "c"]), (1, 2, ["a", "b"]), (1, 3, ["d"]), (1, 4, ["d"]), (2, 1, ["a"])], "item long, n long, c array<string>")
    assert {(r.item, r.n): r.skipped for r in L.attempt_gate(df, "item", "n", "c").collect()} == {(1, 1): False, (1, 2): True, (1, 3): False, (1, 4): True, (2, 1): False}


def test_trend_and_anomaly_guards(spark):
    df = spark.createDataFrame([("flat", k, 2.0) for k in range(5)] + [("up", k, 2.0 * k) for k in range(12)] + [("one", 0, 1.0)], "s string, t long, v double")
    t = {r.s: r for r in N.trend(df, "s", ["t"], "v").collect()}
    assert t["up"].direction == "increasing" and math.isclose(t["up"].slope, 2.0) and t["flat"].direction == "stable" and t["one"].direction == "stable"
    f = N.forecast(N.trend(df, "s", ["t"], "v"), "s").collect()
    assert len(f) == 7 and math.isclose(min(r.value for r in f), 24.0)
    assert N.anomalies(df.where("s <> 'up'"), "s", "v").count() == 0


def test_sequences_need_a_completion(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "done"), (1, 4, "a"), (2, 1, "done"), (2, 2, "a"), (2, 3, "b"), (2, 4, "done")], "u long, t long, e string")
    assert [(r.sequence, r.n) for r in N.sequences(df, "u", ["t"], "e", F.col("e") == "done").collect()] == [("a->b", 2)]
