"""Confidence in an answer from the hits behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspring.functions.scalars import clamp, jaccard, share, words


def confidence(hits: DataFrame, reranked: bool = False) -> DataFrame:
    """qid and relevance, completeness, consistency, quality, overall of hits (qid, question, rank, doc_id, score, content)."""
    terms = lambda c: F.array_distinct(words(F.lower(F.col(c))))
    n = F.length("content")
    df = hits.select(
        "qid", "rank", "doc_id", "score", "content", terms("question").alias("asked"), terms("content").alias("held"),
        ((F.least(F.lit(1.0), n / 500) + share(F.length(F.regexp_replace("content", r"\s", "")), n) + 0.5 + F.when(F.col("content").rlike(r"\d"), 0.3).otherwise(0.0) + F.when(F.col("content").rlike("[.!?;:]"), 0.2).otherwise(0.0)) / 3).alias("quality"),
    )
    # A query's hits are few (a search's limit), so pairs within a query are bounded.
    a, b = df.select("qid", F.col("rank").alias("ra"), F.col("held").alias("ha")), df.select("qid", F.col("rank").alias("rb"), F.col("held").alias("hb"))
    pairs = a.join(b, "qid").where("ra < rb AND size(ha) > 0 AND size(hb) > 0").groupBy("qid").agg(F.avg(jaccard(F.col("ha"), F.col("hb"))).alias("alike"))
    g = df.groupBy("qid").agg(
        F.count("*").alias("n"), F.max("score").alias("hi"), F.min("score").alias("lo"), F.avg("score").alias("avg"), F.stddev_pop("score").alias("sd"),
        F.avg(share(F.size(F.array_intersect("asked", "held")), F.size("asked"))).alias("match"), F.first("asked").alias("asked"),
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("all_held"), F.avg(F.length("content")).alias("length"), F.countDistinct("doc_id").alias("docs"), F.avg("quality").alias("content_quality"),
    ).join(pairs, "qid", "left")
    relevance = clamp((0.3 * F.col("hi") + 0.2 * F.col("avg") + 0.2 * F.col("hi") + 0.2 * F.col("avg") + 0.1 * F.col("match")) * F.greatest(F.lit(0.5), 1.0 - F.col("sd")))
    complete = clamp(0.3 * F.least(F.lit(1.0), F.col("n") / 5.0) + 0.2 * F.least(F.lit(1.0), F.col("length") / 1000) + 0.3 * share(F.size(F.array_intersect("asked", "all_held")), F.size("asked")) + 0.2 * F.least(F.lit(1.0), F.col("docs") / 3.0))
    cv = F.when(F.col("avg") > 0, F.col("sd") / F.col("avg")).otherwise(1.0)
    consistent = F.when(F.col("n") < 2, 0.5).otherwise(clamp(0.4 * F.greatest(F.lit(0.0), 1.0 - cv) + 0.4 * F.coalesce("alike", F.lit(0.5)) + 0.2 * (1.0 - F.col("docs") / F.col("n"))))
    quality = clamp(0.3 * (0.8 if reranked else 0.6) + 0.3 * F.least(F.lit(1.0), (F.col("hi") - F.col("lo")) * 2) + 0.4 * F.col("content_quality"))
    parts = g.select("qid", relevance.alias("relevance"), complete.alias("completeness"), consistent.alias("consistency"), quality.alias("quality"))
    raw = 0.4 * F.col("relevance") + 0.25 * F.col("completeness") + 0.2 * F.col("consistency") + 0.15 * F.col("quality")
    return parts.withColumn("overall", clamp(raw * 0.8, 0.05, 0.95))


def simple_confidence(hits: DataFrame) -> DataFrame:
    """qid, confidence: mean score, damped for few hits, spread scores and short contents."""
    g = hits.groupBy("qid").agg(F.avg("score").alias("a"), F.count("*").alias("n"), F.var_pop("score").alias("v"), F.sum(F.length("content")).alias("c"))
    return g.select("qid", clamp(F.col("a") * F.least(F.lit(1.0), F.col("n") / 5.0) * F.greatest(F.lit(0.5), 1.0 - F.col("v")) * F.least(F.lit(1.0), F.col("c") / 1000.0)).alias("confidence"))
