"""Correlation, trends, anomalies, behaviour, recommendation and conversation measures."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspring.functions.scalars import share, tokens


def correlations(rows: DataFrame, columns: list[str], least: float = 0.7) -> DataFrame:
    """a, b, r, strength, significance of the pairs of columns with abs(r) at or over a bound, in one pass over the rows."""
    pairs = list(combinations(columns, 2))
    one = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.corr(a, b), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs])
    long = one.select("n", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])).alias("x")).select("n", "x.*")
    r = F.abs("r")
    t = r * F.sqrt(F.try_divide(F.col("n") - 2, 1 - r * r))
    return long.where(r >= least).select("a", "b", "r", F.when(r > 0.8, "strong").when(r > 0.5, "moderate").otherwise("weak").alias("strength"), F.when(t > 2, 0.05).otherwise(0.1).alias("significance"))


def trend(rows: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """series, n, slope, r2 (null without variance), direction, last: a line over the index of each series."""
    df = rows.select(series, F.col(value).cast("double").alias("y"), (F.row_number().over(Window.partitionBy(series).orderBy(*order)) - 1).alias("x"))
    g = df.groupBy(series).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.max_by("y", "x").alias("last"))
    return g.withColumn("direction", F.when(F.col("slope") > 0.1, "increasing").when(F.col("slope") < -0.1, "decreasing").otherwise("stable"))


def forecast(trends: DataFrame, series: str, steps: int = 7, least: int = 10) -> DataFrame:
    """series, step, value: the last value carried on along the slope, for series with enough points."""
    df = trends.where(F.col("n") >= least).select(series, "last", "slope", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return df.select(series, F.col("step").cast("long").alias("step"), (F.col("last") + F.col("slope") * F.col("step")).alias("value"))


def anomalies(rows: DataFrame, series: str, value: str, bound: float = 2.0) -> DataFrame:
    """Rows over ``bound`` population deviations from their series' mean, with z; series of under three rows have none.

    Means are joined back by series, so a hot series is a broadcast or a split join and not one window.
    """
    g = rows.groupBy(series).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n"))
    z = F.abs(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")))
    return rows.join(g, series).where("_n >= 3").withColumn("z", z).where(F.col("z") > bound).drop("_m", "_s", "_n")


def feature_share(events: DataFrame, user: str, feature: str, k: int = 5, least: float = 0.1) -> DataFrame:
    """user, feature, n, share, confidence of a user's most used features over a share."""
    g = events.groupBy(user, feature).agg(F.count("*").alias("n"))
    w = Window.partitionBy(user)
    df = g.withColumn("total", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), feature)))
    conf = F.when(F.col("total") < 10, 0.3).when(F.col("total") < 50, 0.6).when(F.col("total") < 100, 0.8).otherwise(0.9)
    return df.select(user, feature, "n", share(F.col("n"), F.col("total")).alias("share"), conf.alias("confidence"), "k").where((F.col("k") <= k) & (F.col("share") > least)).drop("k")


def active_hours(events: DataFrame, user: str, ts: str, k: int = 3) -> DataFrame:
    g = events.groupBy(user, F.hour(ts).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return g.withColumn("k", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("n"), "hour")).cast("long")).where(F.col("k") <= k)


def sequences(events: DataFrame, user: str, order: list[str], step: str, done: Column, k: int = 5) -> DataFrame:
    """sequence, n: steps of a user between completions, joined by ``->``; the k most frequent of all users."""
    w = Window.partitionBy(user).orderBy(*order)
    df = events.withColumn("_done", done.cast("int")).withColumn("_s", F.coalesce(F.sum("_done").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = df.groupBy(user, "_s").agg(F.max("_done").alias("_closed"), F.array_sort(F.collect_list(F.when(F.col("_done") == 0, F.struct(*order, step)))).alias("l"))
    joined = g.where("_closed = 1 AND size(l) > 0").select(F.array_join(F.col("l")[step], "->").alias("sequence"))
    return joined.groupBy("sequence").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sequence").limit(k)


def preference_weights(events: DataFrame, user: str, feature: str, weights: dict[str, float]) -> DataFrame:
    """user, feature, weight: interactions by kind, weighted, as a share of the user's total."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("kind")], F.lit(0.0))
    g = events.groupBy(user, feature).agg(F.sum(w).alias("w"))
    return g.select(user, feature, share(F.col("w"), F.sum("w").over(Window.partitionBy(user))).alias("weight"))


def popularity(items: DataFrame, views: Column, rating: Column, age_days: Column) -> DataFrame:
    return items.withColumn("popularity", (0.1 * views + 0.5 * rating) * F.exp(-0.1 * age_days))


def similar_users(ratings: DataFrame, asked: DataFrame, k: int = 10, salts: int = 16) -> DataFrame:
    """user, other, similarity: cosine over shared items; of each user asked for, the k most similar of all users.

    ratings, asked: (user, item, r), one row per pair; ``asked`` is a stated query set. An item that very many
    have is dealt over ``salts`` tasks: all users' rows by a hash of the user, the asked ones' to each.
    """
    norm = ratings.groupBy("user").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    a = asked.select("user", "item", "r").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    b = ratings.select(F.col("user").alias("other"), "item", F.col("r").alias("r2"), F.pmod(F.xxhash64("user"), F.lit(salts)).cast("int").alias("salt"))
    d = a.join(b, ["item", "salt"]).where("user <> other").groupBy("user", "other").agg(F.sum(F.col("r") * F.col("r2")).alias("dot"))
    s = d.join(norm, "user").join(norm.select(F.col("user").alias("other"), F.col("norm").alias("norm2")), "other")
    s = s.select("user", "other", F.floor(share(F.col("dot"), F.col("norm") * F.col("norm2")) * 1_000_000 + 0.5).cast("long").alias("similarity"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("similarity"), "other"))).where(F.col("k") <= k).drop("k")


def recommend(ratings: DataFrame, similar: DataFrame, k: int = 10) -> DataFrame:
    """user, item, score: what similar users have and the user has not, by summed similarity."""
    held = similar.join(ratings.select(F.col("user").alias("other"), "item", "r"), "other").groupBy("user", "item").agg(F.sum(F.col("similarity") * F.col("r")).alias("score"))
    fresh = held.join(ratings.select("user", "item"), ["user", "item"], "left_anti")
    return fresh.withColumn("k", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item"))).where(F.col("k") <= k).drop("k")


def merge_recommendations(sources: list[DataFrame], k: int = 10) -> DataFrame:
    """user, item, score, source: an item once, from the first source that has it; the best k of each user."""
    every = [s.select("user", "item", "score", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    union = every[0]
    for e in every[1:]:
        union = union.unionByName(e)
    first = union.withColumn("a", F.row_number().over(Window.partitionBy("user", "item").orderBy("source"))).where("a = 1").drop("a")
    return first.withColumn("b", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "source", "item"))).where(F.col("b") <= k).drop("b")


def intents(turns: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """conv_id, turn, intent, score: the intent with the most keyword hits per hundred words; ``none`` without hits."""
    t = tokens(F.col("text"))

    def among(ks: list[str]) -> Column:
        return F.size(F.filter(t, lambda w: w.isin(ks)))

    hits = [F.struct(among(ks).alias("hits"), F.lit(name).alias("intent")) for name, ks in sorted(patterns.items(), reverse=True)]
    best = F.array_max(F.array(*hits))
    df = turns.select("conv_id", "turn", best.alias("b"), F.size(t).alias("n"))
    return df.select("conv_id", "turn", F.when(F.col("b.hits") > 0, F.col("b.intent")).otherwise("none").alias("intent"), F.floor(share(F.col("b.hits") * 100, F.col("n")) * 1e6 + 0.5).cast("long").alias("score"))


def entities(turns: DataFrame) -> DataFrame:
    """conv_id, turn and the distinct numbers, percentages, file names and dates of a text, joined."""
    found = {"numbers": r"\b\d+(?:\.\d+)?\b", "percents": r"\d+(?:\.\d+)?%", "files": r"\b[A-Za-z0-9_-]+\.(?:pdf|csv|json|xlsx)\b", "dates": r"\b\d{4}-\d{2}-\d{2}\b"}
    return turns.select("conv_id", "turn", *[F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))), ",").alias(n) for n, p in found.items()])


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    return turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).cast("long")).where(F.col("back") <= n)


def latency_summary(runs: DataFrame, mode: str, ms: str, ok: Column) -> DataFrame:
    p = F.percentile(ms, F.array(F.lit(0.5), F.lit(0.95)))
    return runs.groupBy(mode).agg(F.count("*").alias("n"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), p.alias("p"), F.max(ms).alias("max")).select(mode, "n", "success", "failed", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "max")


def label_rates(rows: DataFrame, mode: str, label: str, known: list[str]) -> DataFrame:
    """mode ('all' over everything), label, n, share, for each known label also where it has no rows."""
    g = rows.cube(mode, label).agg(F.count("*").alias("n"), F.grouping(mode).alias("gm"), F.grouping(label).alias("gl")).where("gl = 0")
    counts = g.select(F.when(F.col("gm") == 1, "all").otherwise(F.col(mode)).alias("mode"), F.col(label).alias("label"), "n")
    names = rows.sparkSession.createDataFrame([(k,) for k in known], "label string")
    grid = counts.select("mode").distinct().crossJoin(F.broadcast(names))  # a fixed list of labels
    full = grid.join(counts, ["mode", "label"], "left").select("mode", "label", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("share", share(F.col("n"), F.sum("n").over(Window.partitionBy("mode"))))
