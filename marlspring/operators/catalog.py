"""Facets, filters, paging, zero-filled counts, set operations and lookups over a catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspring.functions.scalars import contains_any, share, strip

PAGE_SIZE, MAX_PAGE_SIZE = 10, 100


def split_parameter(value: str | list[str] | None) -> list[str]:
    """Repeated or comma-separated parameter values, trimmed, empty ones dropped."""
    many = value if isinstance(value, list) else [value or ""]
    return [v.strip() for part in many for v in str(part).split(",") if v.strip()]


def filter_catalog(df: DataFrame, contains: dict[str, list[str]] | None = None, one_of: dict[str, list] | None = None, between: dict[str, tuple] | None = None, flags: dict[str, Column] | None = None) -> DataFrame:
    """AND of facets: substring of any value, membership, closed ranges (an open end is None), and extra conditions.

    Every condition is a plain comparison, so membership and ranges reach the Parquet scan.
    """
    for c, terms in (contains or {}).items():
        df = df.where(contains_any(F.col(c), terms))
    for c, values in (one_of or {}).items():
        df = df.where(F.col(c).isin(values)) if values else df
    for c, (low, high) in (between or {}).items():
        df = df.where(F.col(c) >= low) if low is not None else df
        df = df.where(F.col(c) <= high) if high is not None else df
    for condition in (flags or {}).values():
        df = df.where(condition)
    return df


def search_all_terms(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Each word of the query must be a substring of some column."""
    for term in query.split():
        df = df.where(reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(term.lower()) for c in columns]))
    return df


def weighted_search(df: DataFrame, terms: list[str], weights: dict[str, float]) -> DataFrame:
    """Adds match_rank: the sum of the weights of the columns that hold a term, over terms; only rows above 0."""
    total = sum((F.when(F.lower(F.col(c)).contains(t.lower()), w).otherwise(0.0) for t in terms for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("match_rank", total).where("match_rank > 0")


def has_items(c: str) -> Column:
    """Neither null nor an empty array."""
    return F.col(c).isNotNull() & (F.size(c) > 0)


def page(df: DataFrame, order: list[Column], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page by a total order; the size is cut to 1..100, a page past the end is the last one."""
    size = min(max(1, size), MAX_PAGE_SIZE)
    last = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)


def counts_with_zeros(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """column, n for each known value, also those without rows."""
    names = df.sparkSession.createDataFrame([(k,) for k in known], f"{column} string")
    return names.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def top_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def keep_newest(df: DataFrame, key: str, newest: str, tie: str) -> DataFrame:
    """Adds keep: true for the newest row of each key, false for the duplicates."""
    w = Window.partitionBy(key).orderBy(F.desc(newest), tie)
    return df.withColumn("keep", F.row_number().over(w) == 1)


def upsert(existing: DataFrame, new: DataFrame, key: list[str], newest: str) -> DataFrame:
    """Existing and new rows, the newest of each key; a new row wins a tie."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(newest), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def sync_difference(listed: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """key, action: add what is only listed, delete what is only held, keep the rest."""
    a, b = listed.select(key).distinct().withColumn("l", F.lit(1)), held.select(key).distinct().withColumn("h", F.lit(1))
    return a.join(b, key, "full").select(key, F.when(F.col("h").isNull(), "add").when(F.col("l").isNull(), "delete").otherwise("keep").alias("action"))


def two_level_lookup(rows: DataFrame, specific: DataFrame, general: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with a value by all keys, else by the last key alone."""
    s, g = specific.select(*keys, F.col(value).alias("_s")), general.select(keys[-1], F.col(value).alias("_g"))
    return rows.join(s, keys, "left").join(g, keys[-1], "left").withColumn(value, F.coalesce("_s", "_g")).drop("_s", "_g")


def not_known(rows: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """Rows whose key and whose normalized name are both unknown: two anti joins."""
    norm = lambda c: F.lower(strip(c))
    named = known.select(norm(F.col(name)).alias("_n")).distinct()
    return rows.join(known.select(key).distinct(), key, "left_anti").withColumn("_n", norm(F.col(name))).join(named, "_n", "left_anti").drop("_n")


def root_of_chain(rows: DataFrame, key: str, parent: str, rounds: int = 40) -> DataFrame:
    """key, root: parents followed by doubling, up to 2**bits steps for ``rounds`` of that many bits; a cycle ends somewhere on it."""
    at = rows.select(F.col(key), F.coalesce(parent, key).alias("root"))
    for _ in range(rounds.bit_length()):
        nxt = at.select(F.col(key).alias("root"), F.col("root").alias("far"))
        at = at.join(nxt, "root", "left").select(key, F.coalesce("far", "root").alias("root"))
    return at


def co_occurrence(rows: DataFrame, left: str, right: str, k: int) -> DataFrame:
    return rows.groupBy(left, right).agg(F.count("*").alias("n")).orderBy(F.desc("n"), left, right).limit(k)


def group_profile(rows: DataFrame, group: str, name: str, tags: str) -> DataFrame:
    """group, n, names (distinct, sorted, joined), n_tags: distinct tags."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("names"), F.countDistinct(tags).alias("n_tags"))


def completeness(rows: DataFrame, fields: dict[str, float], confidence: Column) -> DataFrame:
    """One row: filled share of each field, confidence bands, and the weighted score with its level."""
    valid = {f: F.avg(F.when(F.col(f).isNotNull() & (strip(F.col(f).cast("string")) != ""), 1.0).otherwise(0.0)) for f in fields}
    score = sum((v * fields[f] for f, v in valid.items()), F.lit(0.0))
    out = rows.agg(
        F.count("*").alias("n"), *[v.alias(f"{f}_share") for f, v in valid.items()],
        F.count_if(confidence >= 0.8).alias("high"), F.count_if((confidence >= 0.6) & (confidence < 0.8)).alias("medium"), F.count_if(confidence < 0.6).alias("low"), score.alias("score"),
    )
    return out.withColumn("level", F.when(F.col("score") >= 0.8, "good").when(F.col("score") >= 0.6, "fair").otherwise("poor"))


def rate(part: Column, whole: Column) -> Column:
    """Whole percent."""
    return F.floor(share(part, whole) * 100).cast("long")
