"""Ranking metrics, token-set precision and recall, error tables and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspring.functions.scalars import share


def clean_run(run: DataFrame) -> DataFrame:
    """method, qid, doc_id, rank: a document once, at its first place; ranks made dense in the order (rank, doc_id)."""
    key = ["method", "qid"]
    first = run.groupBy(*key, "doc_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("rank", "doc_id")).cast("long"))


def ranking_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """method, qid and recall, ndcg (gain 2^rel - 1), binary_ndcg, mrr, judged, retrieved at k; unjudged counts as 0.

    Queries without a relevant document have null metrics, so that means leave them out.
    """
    cut = clean_run(run).where(F.col("rank") <= k)
    found = cut.join(qrels, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("relevance", F.lit(0)))
    gain, log = F.pow(F.lit(2.0), F.col("rel")) - 1, F.log2(F.col("rank") + 1.0)
    got = found.groupBy("method", "qid").agg(
        F.count_if(F.col("rel") > 0).alias("hits"),
        F.sum(gain / log).alias("dcg"),
        F.sum(F.when(F.col("rel") > 0, 1 / log).otherwise(0.0)).alias("bdcg"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"),
        F.count("relevance").alias("judged"),
        F.count("*").alias("retrieved"),
    )
    # Which document comes first among equals changes no sum, so counts say the ideal order; no row is sorted.
    counts = qrels.groupBy("qid", "relevance").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("relevance")))
    counts = counts.withColumn("last", F.least(upto, F.lit(k))).withColumn("begin", F.least(upto - F.col("n"), F.lit(k)))
    weight = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda p: (p > F.col("begin")) & (p <= F.col("last"))), F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1.0))
    ideal = counts.withColumn("weight", weight).groupBy("qid").agg(
        F.sum(F.when(F.col("relevance") > 0, F.col("n")).otherwise(0)).alias("relevant"),
        F.sum((F.pow(F.lit(2.0), F.col("relevance")) - 1) * F.col("weight")).alias("idcg"),
        F.sum(F.when(F.col("relevance") > 0, F.col("weight")).otherwise(0.0)).alias("ibdcg"),
    )
    df = got.join(ideal, "qid", "left")
    some = F.col("relevant") > 0
    return df.select(
        "method", "qid", F.coalesce(some, F.lit(False)).alias("evaluable"),
        F.when(some, F.col("hits") / F.col("relevant")).alias("recall"),
        F.when(some, share(F.col("dcg"), F.col("idcg"))).alias("ndcg"),
        F.when(some, F.least(F.lit(1.0), share(F.col("bdcg"), F.col("ibdcg")))).alias("binary_ndcg"),
        F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        "judged", "retrieved",
    )


def method_summary(per_query: DataFrame) -> DataFrame:
    names = ("recall", "ndcg", "binary_ndcg", "mrr")
    return per_query.groupBy("method").agg(F.count("*").alias("queries"), F.count_if("evaluable").alias("evaluable"), *[F.avg(n).alias(n) for n in names], F.avg(F.when(F.col("ndcg") > 0, 1.0).otherwise(0.0)).alias("hit_rate"))


def pool(run: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, sources (``method:rank`` in order) of the methods' first k."""
    cut = clean_run(run).where(F.col("rank") <= k)
    return cut.groupBy("qid", "doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "method", "rank"))), ";").alias("sources"), F.count("*").alias("n_methods"))


def set_scores(rows: DataFrame, key: str, field: str, predicted: str, gold: str) -> DataFrame:
    """field, tp, fp, fn, precision, recall, f1 (micro) of two token arrays; rows where both are empty don't count."""
    p, g = F.array_distinct(F.coalesce(predicted, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(gold, F.array().cast("array<string>")))
    df = rows.select(field, p.alias("p"), g.alias("g")).where("size(p) > 0 OR size(g) > 0")
    s = df.groupBy(field).agg(F.sum(F.size(F.array_intersect("p", "g"))).alias("tp"), F.sum(F.size(F.array_except("p", "g"))).alias("fp"), F.sum(F.size(F.array_except("g", "p"))).alias("fn"), F.count("*").alias("samples"))
    return with_f1(s)


def exact_scores(rows: DataFrame, field: str, predicted: str, gold: str) -> DataFrame:
    """field and scores of single values: a mismatch is a false positive and a false negative; empty with empty is left out."""
    p, g = F.nullif(F.trim(F.coalesce(predicted, F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce(gold, F.lit(""))), F.lit(""))
    df = rows.select(field, p.alias("p"), g.alias("g")).where("p IS NOT NULL OR g IS NOT NULL")
    same = F.col("p") == F.col("g")
    s = df.groupBy(field).agg(F.count_if(same).alias("tp"), F.count_if(F.col("p").isNotNull() & ~F.coalesce(same, F.lit(False))).alias("fp"), F.count_if(F.col("g").isNotNull() & ~F.coalesce(same, F.lit(False))).alias("fn"), F.count("*").alias("samples"))
    return with_f1(s)


def with_f1(s: DataFrame) -> DataFrame:
    df = s.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return df.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def bootstrap(values: DataFrame, group: str, key: str, value: str, replicates: int = 200, seed: int = 20260402) -> DataFrame:
    """group, mean, lower, upper: percentile interval of the mean over resampled keys, by a seeded hash.

    The values of a group are one row for each query, few by nature; they are kept as one array, and
    each replicate draws from it, so nothing is joined to itself.
    """
    held = values.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))).alias("_a"))
    reps = held.select(group, "_a", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_rep"))
    draw = F.transform(F.sequence(F.lit(1), F.size("_a")), lambda i: F.element_at("_a", (F.pmod(F.xxhash64(F.lit(seed), F.col("_rep"), i), F.size("_a")) + 1).cast("int"))["v"])
    mean = F.aggregate(draw, F.lit(0.0), lambda s, v: s + v) / F.size("_a")
    g = reps.select(group, mean.alias("_mean")).groupBy(group).agg(F.percentile("_mean", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    point = values.groupBy(group).agg(F.avg(value).alias("mean"))
    return point.join(g, group).select(group, "mean", F.col("p")[0].alias("lower"), F.col("p")[1].alias("upper"))
