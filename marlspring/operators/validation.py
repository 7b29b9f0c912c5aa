"""Record validation, checks with weights, and review priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspring.functions.scalars import share
from marlspring.operators.normalize import plain


def field_scores(rows: DataFrame, key: str, required: list[str], vocabulary: dict[str, list[str]]) -> DataFrame:
    """key, score, missing: the mean of the fields' scores. A placeholder scores 0; a field with a vocabulary 1 if it holds a word of it, else 0.5."""

    def one(c: str) -> Column:
        t = plain(F.col(c))
        known = F.lower(t).rlike("|".join(vocabulary[c])) if c in vocabulary else F.lit(True)
        return F.when(t == "", 0.0).when(known, 1.0).otherwise(0.5)

    missing = F.array_compact(F.array(*[F.when(plain(F.col(c)) == "", F.lit(c)) for c in required]))
    return rows.select(key, (sum((one(c) for c in required), F.lit(0.0)) / len(required)).alias("score"), F.array_join(missing, ",").alias("missing"))


def weighted_checks(rows: DataFrame, key: str, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """key, passed, total, pass_rate, weighted: checks with weights; 0.5 without any weight."""
    ok = [c.cast("int") for c, _ in checks.values()]
    weight = sum(w for _, w in checks.values())
    weighted = sum((F.when(c, w).otherwise(0.0) for c, w in checks.values()), F.lit(0.0)) / weight if weight else F.lit(0.5)
    passed = sum(ok, F.lit(0))
    return rows.select(key, passed.cast("long").alias("passed"), F.lit(len(checks)).cast("long").alias("total"), (passed / len(checks)).alias("pass_rate"), weighted.alias("weighted"))


def final_confidence(pass_rate: Column, completeness: Column) -> Column:
    return 0.7 * pass_rate + 0.3 * completeness


def priority(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, 3).when(confidence >= 0.6, 2).otherwise(1)


def class_match(c: Column, classes: list[str]) -> Column:
    """0.9 for a known class, 0.6 where one is part of the text, else 0.3."""
    t = F.lower(plain(c))
    part = t.rlike("|".join(classes))
    return F.when(t.isin(classes), 0.9).when(part, 0.6).otherwise(0.3)


def answer_check(c: Column, keys: list[str]) -> Column:
    """ok, too_short, not_json or no_required_key of a model's answer."""
    value = F.try_parse_json(c)
    some = F.lit(False)
    for k in keys:
        some = some | F.get_json_object(c, f"$.{k}").isNotNull()
    return F.when(F.length(F.coalesce(c, F.lit(""))) < 10, "too_short").when(value.isNull(), "not_json").when(some, "ok").otherwise("no_required_key")


def token_errors(predicted: Column, gold: Column) -> Column:
    """match, missed, invented, mismatch or both_empty of two token arrays."""
    p, g = F.size(F.array_except(predicted, gold)), F.size(F.array_except(gold, predicted))
    return (
        F.when((F.size(predicted) == 0) & (F.size(gold) == 0), "both_empty")
        .when((p == 0) & (g == 0), "match")
        .when(F.size(predicted) == 0, "missed")
        .when(F.size(gold) == 0, "invented")
        .otherwise("mismatch")
    )


def error_table(rows: DataFrame, category: str, key: str, known: list[str]) -> DataFrame:
    """category, n, share, first (the least key) for every known category."""
    g = rows.groupBy(category).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    names = rows.sparkSession.createDataFrame([(k,) for k in known], f"{category} string")
    total = rows.agg(F.count("*").alias("total"))
    full = names.join(g, category, "left").crossJoin(F.broadcast(total))  # total is one row
    return full.select(category, F.coalesce("n", F.lit(0)).alias("n"), share(F.coalesce("n", F.lit(0)), F.col("total")).alias("share"), "first")
