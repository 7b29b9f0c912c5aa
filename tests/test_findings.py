"""Faults that a review found, each on the smallest rows that show it."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marlspring import registry
from marlspring.functions.scalars import q6
from marlspring.operators import academic as A
from marlspring.operators import content as C
from marlspring.operators import ranking as K
from marlspring.operators import retrieval as R


def test_digits_of_a_doi_are_no_year(spark):
    texts = ["10.102010/meteorstudies-2010\nReceived 3 May 1990", "10.2011/2012", "2009, see 10.1234/a.2015", "x" * 2987 + " 10.2020/abc 2016", "in 2014"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [r.year for r in A.paper_metadata(df, 2026).orderBy("doc_id").collect()] == [1990, None, 2009, None, 2014]


@pytest.mark.parametrize("seed", range(2))
def test_kinds_give_what_pairs_give(spark, seed):
    """Few features, so that many users and items are alike; some users have seen all items of their best kinds."""
    rng = random.Random(seed)
    likes = [(u, f"f{f}", rng.choice([-1.0, 0.5, 1.0])) for u in range(30) for f in rng.sample(range(4), 2)] + [(30, None, 1.0), (31, "f9", 1.0)]
    has = [(i, f"f{f}", rng.choice([0.4, 1.0])) for i in range(200) for f in rng.sample(range(4), 1)] + [(200, "f1", None)]
    seen = [(u, i) for u in range(30) for i in rng.sample(range(200), rng.choice([0, 5, 150, 200]))] * 2
    p, i = spark.createDataFrame(likes, "user long, feature string, weight double"), spark.createDataFrame(has, "item long, feature string, value double")
    s = spark.createDataFrame(seen, "user long, item long")
    pairs = C.content_matches(p, i, s)
    kinds = C.Kinds(p, i, s)
    assert kinds.found.count() < 100 < pairs.count()
    assert {tuple(r) for r in C.match_counts(kinds).collect()} == {tuple(r) for r in pairs.groupBy("user").agg(F.count("*"), F.sum("item")).collect()}
    assert sorted(C.best_of_kinds(kinds, s).collect()) == sorted(C.best_matches(pairs).collect())


@pytest.mark.parametrize("how", ["bm25", "overlap"])
def test_best_texts_are_those_of_all_pairs(spark, how, monkeypatch):
    """Ties, empty texts and questions, scopes, and parts and blocks smaller than the rows; a task gives out k texts a question at most."""
    monkeypatch.setattr(K, "DOCS", 7)
    monkeypatch.setattr(K, "QUESTIONS", 2)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(12)] + ["ÄB", "K7", "x-Y"]
    docs = [(d, " ".join(rng.choice(words) for _ in range(rng.randrange(9))), rng.choice(["de", "en"])) for d in range(120)] + [(120, None, "de"), (121, "", None)]
    asked = [(q, " ".join(rng.choice(words) for _ in range(4)), [None, "de", "none"][q % 3]) for q in range(6)] + [(6, "", None), (7, "absent", None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(asked, "qid long, question string, lang string")
    pairs = (R.bm25 if how == "bm25" else R.token_overlap)(d, q).withColumn("s", q6(F.col("score"))).select("qid", "doc_id", "s")
    best = K.best_texts(d, q, how, 5)
    assert {tuple(r) for r in best.select("qid", "doc_id", "s", "rank").collect()} == {tuple(r) for r in R.top_k(pairs, 5, "s").select("qid", "doc_id", "s", "rank").collect()}
    held = pairs.join(d.select("doc_id", "lang"), "doc_id").join(q.select("qid", F.col("lang").alias("scope")), "qid").where("scope IS NULL OR scope = lang").where("s >= 100000")
    got = K.best_texts(d, q, how, 5, scope="lang", least=100_000)
    assert {tuple(r) for r in got.select("qid", "doc_id", "s").collect()} == {tuple(r) for r in R.top_k(held, 5, "s").select("qid", "doc_id", "s").collect()}
    some = pairs.select("qid", "doc_id")
    assert {tuple(r) for r in K.overlap_of(some, d, q).collect()} == {tuple(r) for r in R.token_overlap(d, q).collect()}


def test_vectors_asked_for_are_those_divisible_by_25(spark, tmp_path):
    """A change of the SQL had left only every fourth of them."""
    rows = [(v, [float(v % 7 + 1), float(v % 5), 1.0], v % 3) for v in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("dense_topk", "dense_threshold", "ranking_per_query", "qrels_pool"):
        assert {r.qid for r in registry.queries()[name](spark, str(tmp_path)).select("qid").collect()} == set(range(0, 200, 25)), name
    got = [registry.queries()[name](spark, str(tmp_path)).collect() for name in ("method_summary", "qrels_stats", "unjudged")]
    assert {r.queries for r in got[0]} == {8}
    near = [(a, b) for a in range(0, 200, 25) for b in range(200) if a != b and abs(a % 3 - b % 3) <= 1]
    assert got[1][0].judgments == len(near)


def against_sql(spark, folder, name, **tables):
    """A query's rows and those of its SQL (by one thread, whose sums of doubles have one order), over tables of (rows, schema)."""
    con = duckdb.connect(config={"threads": 1})
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = sorted((tuple(r) for r in registry.queries()[name](spark, str(folder)).collect()), key=repr)
    return got, sorted(con.execute(registry.oracle_sql()[name]).fetchall(), key=repr)


def test_chunk_scores_end_words_where_ascii_ends(spark, tmp_path):
    """Java 17 takes the letter before as part of the word."""
    texts = ["der Räder", "Räder", "the thé éthe", "İder the", "Kder", "der\u0301 the", "x_the the9 the", "doié", "éreferences", "referenceſ a", "referenceſa", "doı", "Bıbliography", None, ""]
    got, want = against_sql(spark, tmp_path, "chunk_scores", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert got == want and (1, 0, 2, "scored") in got


@pytest.mark.parametrize("name", ["content_matches", "content_recommended"])
def test_content_queries_take_all_users(spark, tmp_path, name, monkeypatch):
    """Not every hundredth only; blocks are smaller than the tables, a null buys too, and lines name an order or a part that isn't there."""
    monkeypatch.setattr(C, "USERS", 9)
    monkeypatch.setattr(C, "KINDS", 16)
    rng = random.Random(5)
    parts = [(i, rng.choice(["A", "B", "C", None]), rng.choice(["x", "y", "z"]), rng.randrange(1, 51)) for i in range(150)]
    orders = [(o, rng.choice([*range(40), 100, None])) for o in range(200)] + [(200, 41)]
    lines = [(rng.randrange(205), rng.randrange(155)) for _ in range(700)] + [(200, i) for i in range(150)]
    got, want = against_sql(
        spark, tmp_path, name,
        part=(parts, "p_partkey long, p_brand string, p_type string, p_size int"), orders=(orders, "o_orderkey long, o_custkey long"), lineitem=(lines, "l_orderkey long, l_partkey long"),
    )
    assert got == want and {r[0] for r in got} >= {*range(1, 30), None} and 41 not in {r[0] for r in got}


def test_matches_leave_tasks_as_rows_of_users(spark, monkeypatch):
    """Each block of users gives out a row a user, however many items match."""
    monkeypatch.setattr(C, "USERS", 4)
    p = spark.createDataFrame([(u, f, 1.0) for u in range(20) for f in "ab"], "user long, feature string, weight double")
    i = spark.createDataFrame([(i, "ab"[i % 2], 0.5 + i / 1000) for i in range(400)], "item long, feature string, value double")
    s = spark.createDataFrame([(0, k) for k in range(400)] + [(1, 7), (1, 7), (2, 999)], "user long, item long")
    kinds, rows = C.Kinds(p, i, s), []
    meet = kinds.meet
    monkeypatch.setattr(kinds, "meet", lambda *a: rows.append(meet(*a)) or rows[-1])
    assert {r.user: (r.n, r["items"]) for r in C.match_counts(kinds).collect()} == {1: (399, 79_793)} | {u: (400, 79_800) for u in range(2, 20)}
    assert sorted(tuple(r)[:4] for r in C.best_of_kinds(kinds).where("user < 2").collect()) == [(1, 399 - r, round((0.899 - r / 1000) * 1e6), r + 1) for r in range(10)][::-1]
    assert [r.count() for r in rows] == [19, 190]
