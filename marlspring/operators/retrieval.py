"""Keyword, dense and hybrid retrieval, fusion, reranking, and what is made of the hits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspring.functions.scalars import clamp, cosine, q6, share, sigmoid, tokens, words

#: Parameters of Okapi BM25.
K1, B = 1.2, 0.75
MODES = ("bm25", "dense", "hybrid", "hybrid_rerank")


def top_k(hits: DataFrame, k: int, score: str = "score", part: str = "qid", tie: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The k best hits of each query with their rank; ties by the key columns, so the order is total."""
    w = Window.partitionBy(part).orderBy(F.desc(score), *tie)
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a generator of one row, so that each is computed once, however often it is used above."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _terms(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, distinct n, term, tf) of the queries' terms in documents, and (qid, n_terms, term).

    A document's tokens are cut and counted once, before they are exploded: work is linear in the text.
    """
    asked = queries.select("qid", F.array_distinct(tokens(F.col("question"))).alias("t")).select("qid", F.size("t").alias("n_terms"), F.explode("t").alias("term"))
    cut = once(docs.select("doc_id", "text"), t=tokens(F.col("text"))).select("doc_id", "t")
    held = once(cut, n=F.size("t"), n_distinct=F.size(F.array_distinct("t"))).select("doc_id", "n", "n_distinct", F.explode("t").alias("term"))
    kept = held.join(asked.select("term").distinct(), "term", "left_semi")
    return kept.groupBy("doc_id", "n", "n_distinct", "term").agg(F.count("*").alias("tf")), asked


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, doc_id, score of every document that shares a term with a query (Okapi, idf never negative)."""
    tf, asked = _terms(docs, queries)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    whole = docs.select(F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+")).alias("n")).agg(F.count("*").alias("all"), F.avg("n").alias("avg_n"))
    idf = F.log(1 + (F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("avg_n")))
    scored = tf.join(df, "term").crossJoin(F.broadcast(whole)).select("doc_id", "term", weight.alias("w"))  # whole is one row
    return asked.join(scored, "term").groupBy("qid", "doc_id").agg(F.sum("w").alias("score"))


def token_overlap(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, doc_id, score: Jaccard of the distinct tokens; a scorer that needs no model."""
    tf, asked = _terms(docs, queries)
    both = asked.join(tf, "term").groupBy("qid", "doc_id", "n_terms", "n_distinct").agg(F.count("*").alias("both"))
    return both.select("qid", "doc_id", share(F.col("both"), F.col("n_terms") + F.col("n_distinct") - F.col("both")).alias("score"))


def dense(vectors: DataFrame, queries: DataFrame, max_distance: float = 0.8) -> DataFrame:
    """qid, doc_id, score = cosine, for vectors within a distance; vectors (doc_id, embedding), queries (qid, embedding).

    A stated query set against all vectors: the smaller side is sent to the other's tasks only if
    Spark's own size limit allows.
    """
    pairs = vectors.join(queries.withColumnRenamed("embedding", "asked"), F.lit(True))
    return pairs.select("qid", "doc_id", cosine(F.col("embedding"), F.col("asked")).alias("score")).where(1.0 - F.col("score") <= max_distance)


def fuse(vector: DataFrame, keyword: DataFrame, alpha: Column | float = 0.7) -> DataFrame:
    """qid, doc_id, vector_score, bm25_score, score: min-max per query over positive scores; weighted only where both are positive.

    A keyword score of 1 or less stays as it is; a query whose scores are all equal has range 1.
    """
    alpha = alpha if isinstance(alpha, Column) else F.lit(alpha)
    both = vector.select("qid", "doc_id", F.col("score").alias("v")).join(keyword.select("qid", "doc_id", F.col("score").alias("k")), ["qid", "doc_id"], "full")
    w = Window.partitionBy("qid")
    df = both.select("qid", "doc_id", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("k", F.lit(0.0)).alias("k"))

    def scaled(c: str) -> Column:
        high, low = F.max(F.when(F.col(c) > 0, F.col(c))).over(w), F.min(F.when(F.col(c) > 0, F.col(c))).over(w)
        return (F.col(c) - low) / F.when(high > low, high - low).otherwise(1.0)

    df = df.select("*", F.when(F.col("v") > 0, scaled("v")).otherwise(0.0).alias("nv"), F.when(F.col("k") > 1, scaled("k")).when(F.col("k") > 0, F.col("k")).otherwise(0.0).alias("nk"))
    score = F.when((F.col("v") > 0) & (F.col("k") > 0), alpha * F.col("nv") + (1.0 - alpha) * F.col("nk")).when(F.col("v") > 0, F.col("nv")).otherwise(F.col("nk"))
    return df.select("qid", "doc_id", F.col("v").alias("vector_score"), F.col("k").alias("bm25_score"), score.alias("score"))


def plain_score(s: Column) -> Column:
    """Raw keyword scores above 1 are divided by 10; everything is cut to 0..1."""
    return F.when(s <= 0, 0.0).when(s > 1, F.least(F.lit(1.0), s / 10.0)).otherwise(s)


def rerank(hits: DataFrame, weight: float = 0.6) -> DataFrame:
    """final_score from a hit's score and rerank_score (a logit); hits without one keep their order by score."""
    final = (1.0 - weight) * clamp(F.col("score")) + weight * sigmoid(F.col("rerank_score"))
    return hits.withColumn("final_score", F.coalesce(final, F.col("score")))


def search(mode: str, vector: DataFrame, keyword: DataFrame, limit: int, alpha: float = 0.7, scorer=None) -> DataFrame:
    """qid, doc_id, score, rank by a mode; an unknown mode is hybrid_rerank, an alpha outside 0..1 is 0.7.

    Sources are first cut to twice the limit. ``scorer`` adds rerank_score to hits.
    """
    mode = mode if mode in MODES else "hybrid_rerank"
    alpha = alpha if 0 <= alpha <= 1 else 0.7
    cut = lambda df: top_k(df.withColumn("score", q6(F.col("score")) / 1e6), 2 * limit).drop("rank")
    if mode == "bm25":
        hits = cut(keyword)
    elif mode == "dense":
        hits = cut(vector)
    else:
        hits = fuse(cut(vector), cut(keyword), alpha).select("qid", "doc_id", "score")
        if mode == "hybrid_rerank" and scorer is not None:
            hits = rerank(scorer(hits)).select("qid", "doc_id", F.col("final_score").alias("score"))
    return top_k(hits.withColumn("s6", q6(F.col("score"))), limit, "s6").select("qid", "doc_id", F.col("s6").alias("score"), "rank")


def aggregate_documents(hits: DataFrame) -> DataFrame:
    """qid, doc_id and page span, chunk count, scores and relevance of hits (qid, doc_id, chunk_index, score)."""
    g = hits.groupBy("qid", "doc_id").agg(F.min("chunk_index").alias("min_page"), F.max("chunk_index").alias("max_page"), F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))
    rel = F.least(F.lit(1.0), 0.4 * F.col("avg_score") + 0.4 * F.col("max_score") + 0.2 * F.least(F.lit(1.0), F.col("n") / 5.0))
    return g.withColumn("relevance", rel)


def combine_content(chunked: DataFrame, limit: int = 50_000, least: int = 100, separator: str = "\n\n---\n\n") -> DataFrame:
    """doc_id, content: chunks in order up to a limit of characters; a last piece is cut if over ``least`` characters fit."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("content")).over(w), F.lit(0))
    room = F.lit(limit) - F.col("before")
    kept = chunked.withColumn("before", before).where((F.col("before") + F.length("content") <= limit) | ((room > least) & (F.col("before") < limit)))
    kept = kept.withColumn("content", F.substring("content", F.lit(1), room.cast("int")))
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c")).select("doc_id", F.array_join("c.content", separator).alias("content"))


def context_budget(hits: DataFrame, max_segments: int, max_words: int) -> DataFrame:
    """qid, rank, content: the first segments within a budget of words; the last one is cut to what is left."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    df = hits.where(F.col("rank") <= max_segments).withColumn("w", words(F.col("content")))
    df = df.withColumn("left", F.lit(max_words) - F.coalesce(F.sum(F.size("w")).over(w), F.lit(0))).where(F.col("left") > 0)
    return df.select("qid", "rank", "doc_id", F.array_join(F.slice("w", F.lit(1), F.col("left").cast("int")), " ").alias("content"))


def citations(answers: DataFrame) -> DataFrame:
    """qid, cited (distinct, ascending), valid: every [sN] is within 1..n_sources, every line cites, and there is one."""
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[s(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))
    lines = F.filter(F.split("answer", "\n"), lambda x: F.trim(x) != "")
    ok = (F.size("cited") > 0) & F.forall("cited", lambda k: (k >= 1) & (k <= F.col("n_sources"))) & F.forall(lines, lambda x: x.rlike(r"\[s\d+\]"))
    return answers.withColumn("cited", cited).withColumn("valid", ok)


def keyword_filter(hits: DataFrame, stop: list[str]) -> DataFrame:
    """Hits (qid, question, content) that hold a query word of 3 letters or more; a query without such a hit keeps all."""
    terms = F.filter(tokens(F.col("question")), lambda w: (F.length(w) >= 3) & ~w.isin(stop))
    match = F.exists(terms, lambda w: F.contains(F.lower(F.col("content")), w))
    df = hits.withColumn("m", F.coalesce(match, F.lit(False)))
    return df.withColumn("some", F.max("m").over(Window.partitionBy("qid"))).where(F.col("m") | ~F.col("some")).drop("m", "some")


def adaptive_threshold(hits: DataFrame) -> DataFrame:
    """Where a query's scores spread widely, hits at or over max(avg - 1.5 sd, 0.06, 0.9 min), that bound cut to half the best."""
    w = Window.partitionBy("qid")
    avg, sd, low, high = F.avg("score").over(w), F.stddev_pop("score").over(w), F.min("score").over(w), F.max("score").over(w)
    bound = F.least(F.greatest(avg - 1.5 * sd, F.lit(0.06), 0.9 * low), 0.5 * high)
    return hits.withColumn("bound", F.when(sd > 0.5 * avg, bound)).where(F.col("bound").isNull() | (F.col("score") >= F.col("bound"))).drop("bound")


def keyword_index(entries: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """key, score: one point for each keyword that holds the query, two more where it equals it."""
    k, q = F.lower(F.col("keyword")), query.lower()
    s = F.sum(F.when(k == q, 3).when(k.contains(q), 1).otherwise(0))
    return entries.groupBy("key").agg(s.alias("score")).where("score > 0").orderBy(F.desc("score"), "key").limit(limit)


def neighbours(hits: DataFrame, chunked: DataFrame, distance: int = 1) -> DataFrame:
    """qid, doc_id, chunk_index, content of the hits' chunks and those beside them, each once."""
    near = hits.select("qid", "doc_id", F.explode(F.sequence(F.col("chunk_index") - distance, F.col("chunk_index") + distance)).alias("chunk_index")).distinct()
    return near.join(chunked, ["doc_id", "chunk_index"]).select("qid", "doc_id", "chunk_index", "content")


def mmr(hits: DataFrame, k: int = 8, per_doc: int = 2, balance: float = 1.0) -> DataFrame:
    """qid, pos, doc_id, chunk_index chosen greedily by score less the highest cosine to what is chosen, with a quota per document.

    Hits (qid, doc_id, chunk_index, score, embedding) of one query are few (a search's limit).
    """
    import numpy as np

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "doc_id", "chunk_index"], ascending=[False, True, True]).reset_index(drop=True)
        e = np.stack(g["embedding"].to_numpy()).astype(float)
        e /= np.linalg.norm(e, axis=1, keepdims=True) + 1e-12
        chosen, used, worst = [], {}, np.full(len(g), -1.0)
        while len(chosen) < k:
            open_ = [i for i in range(len(g)) if i not in chosen and used.get(g.doc_id[i], 0) < per_doc]
            if not open_:
                break
            best = max(open_, key=lambda i: (g.score[i] - (balance * worst[i] if chosen else 0.0), -i))
            chosen.append(best)
            used[g.doc_id[best]] = used.get(g.doc_id[best], 0) + 1
            worst = np.maximum(worst, e @ e[best])
        out = g.loc[chosen, ["qid", "doc_id", "chunk_index"]].copy()
        out.insert(1, "pos", range(1, len(out) + 1))
        return out

    return hits.groupBy("qid").applyInPandas(choose, "qid long, pos long, doc_id long, chunk_index long")
