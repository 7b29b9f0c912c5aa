"""Search in stages, vectors in blocks, order statistics, checkpoints, sections and reports against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspring.operators import blocks as B
from marlspring.operators import cascade as K
from marlspring.operators import reports as O
from marlspring.operators.listing import eviction
from marlspring.operators.retrieval import top_k
from marlspring.streaming import checkpoints as C
from marlspring.streaming import jobs as J


def test_later_stages_only_see_queries_that_lack_hits(spark):
    queries = spark.createDataFrame([(k, f"q{k}") for k in range(6)], "qid long, question string")
    first = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (1, 1, 0.5)], "qid long, doc_id long, score double")
    second = spark.createDataFrame([(0, 9, 1.0), (1, 7, 0.4), (2, 8, 0.3), (2, 9, 0.3)], "qid long, doc_id long, score double")
    last = spark.createDataFrame([(k, 100, 0.1) for k in range(5)], "qid long, doc_id long, score double")
    seen = {}

    def stage(name, hits):
        def search(asked):
            seen[name] = {r.qid for r in asked.collect()}
            return hits.join(asked.select("qid"), "qid")

        return name, search

    got = K.staged(queries, [stage("a", first), stage("b", second), stage("c", last)], least=2)
    assert {(r.qid, r.doc_id, r.stage) for r in got.collect()} == {(0, 1, "a"), (0, 2, "a"), (2, 8, "b"), (2, 9, "b"), (1, 100, "c"), (3, 100, "c"), (4, 100, "c")}
    assert seen == {"a": set(range(6)), "b": {1, 2, 3, 4, 5}, "c": {1, 3, 4, 5}}


def test_budgets_of_wide_narrow_and_empty_searches(spark):
    asked = spark.createDataFrame([(1, 5, None), (2, 0, None), (3, None, None), (4, 4000, None), (5, 6000, None), (6, 5, "s"), (7, 5, "none"), (8, 5, "many")], "qid long, limit long, scope string")
    allowed = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2), (None, 3), *[("many", k) for k in range(100)]], "scope string, doc_id long")
    got = {r.qid: (r.n_allowed, r.effective, r.candidates, r.reranked, r.kept) for r in K.budgets(asked, allowed).collect()}
    assert got == {
        1: (None, 5, 15, 10, 5), 2: (None, 1, 3, 2, 1), 3: (None, 1, 3, 2, 1), 4: (None, 4000, 10_000, 8000, 4000), 5: (None, 6000, 10_000, None, None),
        6: (2, 2, 6, 4, 2), 7: (0, 0, 0, 0, 0), 8: (100, 5, 15, 10, 5),
    }


def test_full_search_keeps_to_scope_limits_and_order(spark):
    asked = spark.createDataFrame([(1, "a", 2, None), (2, "b", 2, "s"), (3, "c", 2, "none"), (4, "d", 2, "t"), (5, "e", 9000, None)], "qid long, question string, limit long, scope string")
    allowed = spark.createDataFrame([("s", 10), ("s", 11), ("s", 10), ("t", 20)], "scope string, doc_id long")
    near = spark.createDataFrame([(1, d, 0.5) for d in range(20)] + [(2, d, d / 100) for d in range(9, 13)] + [(3, 1, 0.9), (4, 1, 0.9)], "qid long, doc_id long, score double")
    words = spark.createDataFrame([(4, 20, 3.0), (4, 21, 9.0)] + [(5, d, float(d)) for d in range(30)], "qid long, doc_id long, score double")
    stages = [("near", lambda a: near.join(a.select("qid"), "qid")), ("words", lambda a: words.join(a.select("qid"), "qid"))]
    rows = K.full_search(asked, allowed, stages).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id, r.stage) for r in rows if r.qid < 5] == [(1, 0, "near"), (1, 1, "near"), (2, 11, "near"), (2, 10, "near"), (4, 20, "words")]
    assert [r.doc_id for r in rows if r.qid == 5] == list(range(29, -1, -1))
    # The reranker sees six candidates of question 1 and turns them round; only ids up to 5 can come first.
    turned = K.full_search(asked, allowed, stages, lambda hits: hits.withColumn("rerank_score", F.col("doc_id").cast("double")))
    assert [r.doc_id for r in turned.where("qid = 1").orderBy("rank").collect()] == [5, 4]


def test_nearest_chunks_and_replaced_scores(spark):
    rows = [(1, 1, 0, 0, 0.9), (1, 1, 0, 3, 0.8), (1, 1, None, 0, 0.7), (1, 1, None, 5, 0.6), (1, 2, 0, 0, 0.5), (1, 3, 1, 0, 0.4), (2, 1, 0, 0, 0.1), (2, 1, None, None, 0.05), (2, 1, None, None, 0.04)]
    hits = spark.createDataFrame(rows, "qid long, doc_id long, chunk_index long, page long, score double")
    got = K.nearest_chunks(hits, 5)
    assert [(r.qid, r.rank) for r in got.orderBy("qid", "rank").collect()] == [(1, 1), (1, 4), (1, 5), (2, 1), (2, 2)]
    again = K.replaced_by_rerank(got, F.when(F.col("qid") == 1, F.col("rank") * 10), 2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id, r.score) for r in again] == [(1, 2, 50.0), (1, 1, 40.0), (2, 1, 0.1), (2, 1, 0.05)]


@pytest.mark.parametrize("sizes", [(4096, 1024), (7, 3)])
def test_vectors_in_blocks_equal_all_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(B, "VECTORS", sizes[0])
    monkeypatch.setattr(B, "QUERIES", sizes[1])
    rng = np.random.default_rng(3)
    held = {k: [float(x) for x in rng.integers(-2, 3, 4)] for k in range(60)}
    held |= {k: held[k % 5] for k in range(60, 80)}
    odd = {90: None, 91: [1.0, None, 0.0, 0.0], 92: [1.0, 2.0], 93: [float("nan")] * 4, 94: [0.0] * 4, 95: [float("inf"), 0.0, 0.0, 0.0]}
    vectors = spark.createDataFrame(list((held | odd).items()), "doc_id long, embedding array<double>")
    queries = vectors.where("doc_id % 9 = 0 OR doc_id = 92").select(F.col("doc_id").alias("qid"), "embedding")
    held[94] = odd[94]

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return int(np.floor(np.dot(a, b) / n * 1e6 + 0.5)) if n else 0

    every = {q: sorted((-cosine(held[q], v), k) for k, v in held.items() if k != q) for q in held if q % 9 == 0}
    got = top_k(B.dense_blocks(vectors, queries, 6), 6).collect()
    pairs = {q: [(r.score, r.doc_id) for r in sorted(got, key=lambda r: r.rank) if r.qid == q] for q in every}
    # Scores of parallel vectors may differ in the last millionth, and ties with them; the scores themselves are compared.
    for q, want in every.items():
        assert [s for s, _ in pairs[q]] == pytest.approx([-s for s, _ in want[:6]], abs=1)
        assert all(abs(cosine(held[q], held[k]) - s) <= 1 for s, k in pairs[q])
    assert {r.qid for r in got} == set(every)
    n = {r.qid: r.n for r in B.dense_blocks(vectors, queries, least=300_000).groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert n == {q: sum(-s >= 300_000 for s, _ in w) for q, w in every.items() if any(-s >= 300_000 for s, _ in w)}
    assert B.dense_blocks(vectors.limit(0), queries, 3).count() == 0 == B.dense_blocks(vectors, queries.limit(0), 3).count()


def test_nth_smallest_and_eviction_equal_sorting(spark):
    rng = random.Random(4)
    values = [rng.choice([7, 7, 7, -(10**15), rng.randrange(-50, 50), rng.randrange(10**12)]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(3)
    for n in (1, 2, 200, 399, 400):
        assert B.nth_smallest(df, "v", n, bins=8) == sorted(values)[n - 1]
    assert B.nth_smallest(df, "v", 401) is None and B.nth_smallest(df, "v", 0) is None
    rows = [(k, rng.randrange(3)) for k in range(95)]
    kept = eviction(spark.createDataFrame(rows, "k long, a long"), "k", F.col("a"), F.lit(0), 0.3)
    assert sorted((r.worth, r.k) for r in kept.collect()) == sorted((a, k) for k, a in rows)[:28]
    few = spark.createDataFrame([(1, None), (2, 5)], "k long, a long")
    assert [r.k for r in eviction(few, "k", F.col("a"), F.lit(0)).collect()] == [2]
    assert eviction(few.limit(0), "k", F.col("a"), F.lit(0)).count() == 0


def test_checkpoints_are_counted_pruned_and_loaded(spark, tmp_path):
    base, tasks = str(tmp_path / "points"), spark.createDataFrame([("a b",), ("7",), ("none",), ("none",)], "task string")
    state = "created_at string, done long"
    assert [(r.has_checkpoints, r.checkpoints, r.total_size) for r in C.statistics(spark, base, tasks).collect()] == [(False, 0, 0)] * 3
    rows = [(t, v, f"2024-01-{v + 1:02d}", v * 10) for t, n in (("a b", 25), ("7", 3)) for v in range(n)]
    C.write(spark.createDataFrame(rows, f"task string, version long, {state}").repartition(5), base)
    assert C.prune(spark, base, 20) == 5 and C.prune(spark, base, 20) == 0
    told = {r.task: r for r in C.statistics(spark, base, tasks).collect()}
    assert {t: (r.has_checkpoints, r.checkpoints, r.latest_time) for t, r in told.items()} == {"a b": (True, 20, "2024-01-25"), "7": (True, 3, "2024-01-03"), "none": (False, 0, None)}
    assert told["7"].total_size == sum(len(f'{{"created_at":"2024-01-0{v + 1}","done":{v * 10}}}') + 1 for v in range(3)) and told["7"].total_size_mb == 0.0
    assert {r.task: (r.version, r.done) for r in C.latest(spark, base, state).collect()} == {"a b": (24, 240), "7": (2, 20)}
    (tmp_path / "points" / "task=7" / "version=9").mkdir()
    (tmp_path / "points" / "task=7" / "version=9" / "part-0.txt").write_text("not json\n")
    broken = {r.task: (r.version, r.done) for r in C.latest(spark, base, state).collect()}
    assert broken["7"] == (9, None)
    assert {r.task: r.latest_time for r in C.statistics(spark, base, tasks).collect()}["7"] is None


def test_polled_folder_takes_files_as_they_come(spark, tmp_path):
    source, seen = tmp_path / "in", []
    rows = spark.createDataFrame([(k,) for k in range(5)], "k long")
    rows.where("k < 3").write.parquet(str(source))
    q = J.run_polled(J.folder(spark, str(source), rows.schema), lambda df, _: seen.extend(r.k for r in df.collect()), str(tmp_path / "check"), "200 milliseconds")
    try:
        until = time.monotonic() + 60
        while len(seen) < 3 and time.monotonic() < until:
            time.sleep(0.2)
        rows.where("k >= 3").write.mode("append").parquet(str(source))
        while len(seen) < 5 and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        q.stop()
    assert sorted(seen) == list(range(5))


def walked(text, marks, repeated):
    section, found = None, []
    for pos, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if not line:
            continue
        section = next((s for s, words in marks if any(w in line.lower() for w in words)), section)
        if section and ":" in line:
            field, value = (x.strip() for x in line.split(":", 1))
            if section not in repeated:
                found = [f for f in found if (f[0], f[2]) != (section, field)]
            found.append((section, pos, field, value))
    return sorted(found)


def test_sections_equal_the_walk(spark):
    rng, marks = random.Random(6), [("rock", ["rock", "stone"]), ("compound", ["amino"]), ("reference", ["reference"])]
    words = ["Rock", "stone data:", "amino acids", "References", "a: 1", "a : 2", " b:3:4 ", ":", "x", "", "  ", "title: t", "a: 9", "AMINO: yes"]
    texts = {k: "\n".join(rng.choices(words, k=rng.randrange(12))) for k in range(150)} | {200: None, 201: "", 202: "\n" * 300 + "stone: x"}
    df = spark.createDataFrame(list(texts.items()), "id long, t string").withColumn("pos", F.lit("clash")).select("id", "t")
    got = {k: [] for k in texts}
    for r in O.sections(df, ["id"], "t", marks, ("reference",)).collect():
        got[r.id].append((r.section, r.pos, r.field, r.value))
    assert {k: sorted(v) for k, v in got.items()} == {k: walked(t, marks, ("reference",)) for k, t in texts.items()}


def test_insights_and_averages(spark):
    rows = [("correlation", f"c{k}", x) for k, x in enumerate((0.81, -0.99, 0.8, 0.9, 0.9, None))] + [("trend", "t", 0.7), ("anomaly", "a", 0.2), ("anomaly", "n", float("nan")), ("other", "o", 9.0)]
    got = {r.kind: (r.n, r["items"]) for r in O.insights(spark.createDataFrame(rows, "kind string, name string, measure double")).collect()}
    assert got == {"correlation": (4, "c1; c3; c4"), "anomaly": (1, "a")}
    df = spark.createDataFrame([(1, None, None), (4, 2.0, None)], "a long, b double, c double")
    assert [tuple(r) for r in O.averages(df, "batch", ["a", "b", "c"]).collect()] == [("batch", "a", 2, 2.5), ("batch", "b", 1, 2.0), ("batch", "c", 0, 0.0)]
    assert [r.average for r in O.averages(df.limit(0), "batch", ["a"]).collect()] == [0.0]
