"""Normalization, alignment and merging of extracted records."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspring.functions.scalars import strip

#: Texts that stand for nothing.
PLACEHOLDERS = ["", "unknown", "n/a", "na", "none", "null", "not specified", "{}", "[]"]


def plain(c: Column) -> Column:
    """White space collapsed; placeholders become the empty string."""
    t = strip(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))
    return F.when(F.lower(t).isin(PLACEHOLDERS), "").otherwise(t)


def phrases(c: Column) -> Column:
    """Parts of a text between commas and semicolons (also full-width ones), cleaned, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,，；、]"), plain), lambda x: x != "")


def distinct_ignoring_case(c: Column, cap: int) -> Column:
    """The first of equal texts (case ignored), in order, ``cap`` at most."""
    none = F.array().cast("array<string>")
    fresh = lambda kept, x: (F.size(kept) < cap) & ~F.exists(kept, lambda k: F.lower(k) == F.lower(x))
    return F.aggregate(c, none, lambda kept, x: F.when(fresh(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def canonical(c: Column, rules: list[tuple[str, str]], cap: int, max_words: int = 12) -> Column:
    """Each phrase's canonical names by the rules (pattern, name) that match it, else the phrase itself, cut; distinct."""

    def one(p: Column) -> Column:
        named = F.array_compact(F.array(*[F.when(F.lower(p).rlike(pattern), F.lit(name)) for pattern, name in rules]))
        cut = F.array_join(F.slice(F.split(p, " "), 1, max_words), " ")
        return F.when(F.size(named) > 0, named).otherwise(F.array(cut))

    return distinct_ignoring_case(F.flatten(F.transform(phrases(c), one)), cap)


def names(c: Column, code: str, known: dict[str, str], cap: int = 3) -> Column:
    """Codes by a pattern and known names of a text, joined; else the text if it is short and no sentence, else empty."""
    t = plain(c)
    codes = F.regexp_extract_all(t, F.lit(code), F.lit(0))
    found = F.transform(F.regexp_extract_all(F.lower(t), F.lit(r"\b(" + "|".join(known) + r")\b"), F.lit(1)), lambda w: F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[w])
    joined = F.array_join(distinct_ignoring_case(F.concat(codes, found), cap), "; ")
    short = (F.size(F.split(t, " ")) <= 5) & (F.length(t) <= 48) & t.rlike("[A-Za-z0-9]") & ~F.lower(t).rlike(r" by | et al|doi|https?://")
    return F.when(joined != "", joined).when(short, t).otherwise("")


def keep_matching(c: Column, keep: str, drop: str) -> tuple[Column, Column]:
    """(kept, removed): tokens that match ``keep`` or don't match ``drop``, and the rest."""
    ok = lambda x: F.lower(x).rlike(keep) | ~F.lower(x).rlike(drop)
    return F.filter(c, ok), F.filter(c, lambda x: ~ok(x))


def projected(c: Column, classes: list[tuple[str, str]]) -> Column:
    """Each token's first matching class, distinct, in order."""
    first = lambda x: F.coalesce(*[F.when(F.lower(x).rlike(p), F.lit(n)) for p, n in classes])
    return F.array_distinct(F.array_compact(F.transform(c, first)))


def vote(rows: DataFrame, key: str, order: str, tokens: str, cap: int) -> DataFrame:
    """key, tokens: the union of a key's tokens over its rows in order, distinct, ``cap`` at most."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).alias("t")))).alias("l"))
    return g.select(key, distinct_ignoring_case(F.flatten(F.col("l.t")), cap).alias("tokens"))


def existing_keys(approved: DataFrame, pending: DataFrame, name: str, kind: str, tie: str) -> DataFrame:
    """entity (lower name and kind), source, id: an approved row wins over a pending one, then the least id."""
    both = approved.withColumn("source", F.lit("approved")).unionByName(pending.withColumn("source", F.lit("pending")))
    k = F.concat_ws("|", F.lower(F.col(name)), F.lower(F.col(kind)))
    return both.withColumn("entity", k).withColumn("_k", F.row_number().over(Window.partitionBy("entity").orderBy("source", tie))).where("_k = 1").select("entity", "source", F.col(tie).alias("id"))


def merge_records(old: DataFrame, new: DataFrame, key: str, lists: list[str], texts: list[str], confidence: str) -> DataFrame:
    """Matched records of two frames: lists united, unknown texts filled, confidences averaged."""
    o, n = old.alias("o"), new.alias("n")
    blank = lambda c: plain(F.col(c)) == ""
    return o.join(n, key).select(
        key,
        *[F.array_sort(F.array_union(F.col(f"o.{c}"), F.col(f"n.{c}"))).alias(c) for c in lists],
        *[F.when(blank(f"o.{c}"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in texts],
        ((F.col(f"o.{confidence}") + F.col(f"n.{confidence}")) / 2).alias(confidence),
    )


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def best_match(new: DataFrame, existing: DataFrame, block: Column, name: str, key: str, least: float = 0.8) -> DataFrame:
    """new key, existing key, ratio: the most similar existing name within a block, at or over a bound; ties by the least key.

    The block (for instance a name's first letters and length band) keeps the comparison from pairing everything.
    """
    ratio = F.pandas_udf(_ratio, "double")
    a = new.select(F.col(key).alias("new_key"), F.col(name).alias("a"), block.alias("b"))
    b = existing.select(F.col(key).alias("old_key"), F.col(name).alias("c"), block.alias("b"))
    scored = a.join(b, "b").where("new_key <> old_key").withColumn("ratio", ratio("a", "c")).where(F.col("ratio") >= least)
    best = scored.groupBy("new_key").agg(F.max(F.struct("ratio", (-F.col("old_key")).alias("k"))).alias("m"))
    return best.select("new_key", (-F.col("m.k")).alias("old_key"), F.col("m.ratio").alias("ratio"))


def candidate_score(rows: DataFrame, text: str, weights: dict[str, int], hard: str, soft: str) -> DataFrame:
    """Adds score, reasons, excluded: weights of the patterns a text matches, ten off for soft risks, out for hard ones."""
    t = F.lower(F.col(text))
    score = sum((F.when(t.rlike(p), w).otherwise(0) for p, w in weights.items()), F.lit(0)) - F.when(t.rlike(soft), 10).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(p)) for p in weights], F.when(t.rlike(soft), F.lit("soft"))))
    out = rows.withColumn("score", score.cast("long")).withColumn("reasons", F.array_join(reasons, ",")).withColumn("excluded", t.rlike(hard))
    return out.withColumn("bucket", F.when(F.col("excluded"), "out").when(F.col("score") >= 24, "high").when(F.col("score") >= 16, "medium").otherwise("low"))


def pick_diverse(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """group, pos, key chosen one by one by base + 2 * new tags - repeated tags (rows: base, tags).

    Of rows with one base and one set of tags only the k least keys can be picked, so only they are gathered by group.
    """
    alike = Window.partitionBy(group, "base", F.array_sort(F.array_distinct("tags"))).orderBy(key)
    rows = rows.withColumn("_k", F.row_number().over(alike)).where(F.col("_k") <= k).select(group, key, "base", "tags")

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        left, seen, out = {r[key]: (r["base"], set(r["tags"])) for _, r in g.iterrows()}, set(), []
        while left and len(out) < k:
            best = max(left, key=lambda x: (left[x][0] + 2 * len(left[x][1] - seen) - len(left[x][1] & seen), -x))
            seen |= left.pop(best)[1]
            out.append(best)
        return pd.DataFrame({group: g[group].iloc[0], "pos": range(1, len(out) + 1), key: out})

    return rows.groupBy(group).applyInPandas(choose, f"{group} string, pos long, {key} long")


def references(c: Column) -> Column:
    """A reference line's parts: doi, url, year, first author."""
    take = lambda p, g=1: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    return F.struct(take(r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)").alias("doi"), take(r"(https?://\S+)").alias("url"), take(r"\b((?:19|20)\d\d)\b").alias("year"), take(r"^\s*([A-Z][a-z]+(?: [A-Z]\.)?)").alias("author"))

