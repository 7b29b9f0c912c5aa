"""Searches in stages: budgets, fallbacks for queries that still lack hits, repeated chunks, scores replaced by a reranker's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspring.operators.retrieval import rerank, top_k

#: The most candidates a store gives, and the limit from which on nothing is cut.
MOST_CANDIDATES, WHOLE_FROM = 10_000, 5_000

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def budgets(asked: DataFrame, allowed: DataFrame) -> DataFrame:
    """asked (qid, limit, scope) with n_allowed, effective, candidates, reranked, kept; ``allowed`` is (scope, doc_id).

    A null scope allows every document (n_allowed null); a scope without documents allows none. A limit under 1 or
    null counts as 1. ``reranked`` and ``kept`` are null where nothing is cut: above 5000.
    """
    sizes = allowed.where(F.col("scope").isNotNull()).groupBy("scope").agg(F.countDistinct("doc_id").alias("_n"))
    n = F.when(F.col("scope").isNotNull(), F.coalesce("_n", F.lit(0)))
    df = asked.join(sizes, "scope", "left").withColumn("n_allowed", n).drop("_n")
    df = df.withColumn("effective", F.least(F.greatest(F.lit(1), F.coalesce("limit", F.lit(1))).cast("long"), F.col("n_allowed")))
    few = F.col("n_allowed").isNotNull()
    room = lambda factor: F.when(few, F.greatest(F.col("effective"), factor * F.col("n_allowed")))
    reranked = F.least(F.when(F.col("effective") <= WHOLE_FROM, 2 * F.col("effective")), room(2))
    return df.withColumns(
        {
            "candidates": F.least(3 * F.col("effective"), F.lit(MOST_CANDIDATES), room(3)),
            "reranked": reranked,
            "kept": F.when(F.coalesce("limit", F.lit(1)) <= WHOLE_FROM, F.col("effective")),
        }
    )


def staged(queries: DataFrame, stages: list[Stage], keep: Callable[[DataFrame], DataFrame] = lambda hits: hits, least: int = 1) -> DataFrame:
    """qid, doc_id, score, stage: the hits of the first stage that has ``least`` hits (after ``keep``) for the query, else of the last.

    A stage is a name and a function from queries to hits (qid, doc_id, score); it is handed only the queries that no
    stage before has served, so what it costs falls with them. All of it is one plan.
    """
    left, found = queries, []
    for k, (name, search) in enumerate(stages):
        hits = keep(search(left)).select("qid", "doc_id", "score")
        if k < len(stages) - 1:
            served = hits.groupBy("qid").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("qid")
            hits, left = hits.join(served, "qid", "left_semi"), left.join(served, "qid", "left_anti")
        found.append(hits.withColumn("stage", F.lit(name)))
    out = found[0]
    for hits in found[1:]:
        out = out.unionByName(hits)
    return out


def _first(hits: DataFrame, score: str, bound: str) -> DataFrame:
    """The best hits of each query up to its bound; a null bound keeps all."""
    w = Window.partitionBy("qid").orderBy(F.desc(score), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col(bound).isNull() | (F.col("rank") <= F.col(bound)))


def full_search(asked: DataFrame, allowed: DataFrame, stages: list[Stage], scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """qid, doc_id, score, stage, rank of asked (qid, question, limit, scope) within the documents that its scope allows.

    Candidates are cut to thrice what is wanted, reranked ones (``scorer`` adds rerank_score) to twice, results to the
    limit, or not at all above 5000. Ties go by doc_id; a query whose scope allows nothing has no rows.
    """
    told = budgets(asked, allowed)
    limits = told.select("qid", "scope", "candidates", "reranked", "kept")
    scopes = allowed.where(F.col("scope").isNotNull()).select(F.col("scope").alias("_scope"), "doc_id").distinct()

    def within(hits: DataFrame) -> DataFrame:
        df = hits.join(limits.select("qid", "scope"), "qid")
        free = df.where(F.col("scope").isNull()).select("qid", "doc_id", "score")
        bound = df.where(F.col("scope").isNotNull())
        held = bound.join(scopes, (bound["scope"] == scopes["_scope"]) & (bound["doc_id"] == scopes["doc_id"]), "left_semi").select("qid", "doc_id", "score")
        return free.unionByName(held)

    hits = staged(told.where(F.col("effective") > 0).select("qid", "question"), stages, within)
    hits = _first(hits.join(limits.drop("scope"), "qid"), "score", "candidates")
    if scorer is not None:
        hits = rerank(scorer(hits)).withColumn("score", F.col("final_score"))
        hits = _first(hits, "score", "reranked")
    return _first(hits, "score", "kept").select("qid", "doc_id", "score", "stage", "rank")


def nearest_chunks(hits: DataFrame, k: int) -> DataFrame:
    """Of each query's first k hits (qid, doc_id, chunk_index, page, score) the first of each chunk, or page where no chunk is named.

    The cut comes before repeated ones go, so a query may keep fewer than k. Order: score, doc_id, page, chunk_index.
    """
    best = top_k(hits, k, tie=("doc_id", "page", "chunk_index"))
    same = Window.partitionBy("qid", "doc_id", F.coalesce("chunk_index", "page")).orderBy("rank")
    return best.withColumn("_of", F.row_number().over(same)).where("_of = 1").drop("_of")


def replaced_by_rerank(hits: DataFrame, rerank_score: Column, k: int | None = None, tie: tuple[str, ...] = ("rank",)) -> DataFrame:
    """Hits with the reranker's raw score as score, ordered by it and cut to k; queries without one keep score and order."""
    w = Window.partitionBy("qid")
    df = hits.withColumn("_new", rerank_score).withColumn("_some", F.count("_new").over(w) > 0)
    score = F.when(F.col("_some"), F.col("_new").cast("double")).otherwise(F.col("score"))
    order = Window.partitionBy("qid").orderBy(F.when(F.col("_some"), F.col("_new").cast("double")).desc_nulls_last(), *tie)
    df = df.withColumn("_place", F.row_number().over(order).cast("long")).withColumn("score", score).withColumn("rank", F.col("_place")).drop("_new", "_some", "_place")
    return df if k is None else df.where(F.col("rank") <= k)
