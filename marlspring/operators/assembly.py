"""Rows skipped, joined, picked and scored while gold sets and uploads are put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspring.functions.scalars import share, strip

# Spellings of yes, no and a positive judgement.
YES = ["yes", "y", "true", "1"]
NO = ["no", "n", "false", "0"]
POSITIVE = ["1", "yes", "y", "true", "relevant"]


def _spelling(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def blank(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit(""))) == ""


def skipped(skip_row: Column, in_scope: Column) -> Column:
    """Whether a row is left out: it says so, or it is said to be out of scope. Other spellings and nulls decide nothing."""
    return _spelling(skip_row).isin(YES) | _spelling(in_scope).isin(NO)


def coverage(rows: DataFrame, left_out: Column, by: list[str]) -> DataFrame:
    """Rows in all, evaluated and skipped, and the evaluated share (0 without rows)."""
    n = rows.groupBy(*by).agg(F.count("*").alias("total_rows"), F.count_if(~left_out).alias("evaluated_rows"))
    return n.withColumn("skipped_rows", F.col("total_rows") - F.col("evaluated_rows")).withColumn("coverage_rate", share(F.col("evaluated_rows"), F.col("total_rows")))


def results_to_documents(hits: DataFrame, documents: DataFrame, qid: str, key: str, place: str, chunk: str) -> DataFrame:
    """Each query's documents with the chunks that were hit, in the order of places; `found` is false where no document is held.

    A list holds the hits of one query in one document, which a search's limit bounds.
    """
    lists = hits.groupBy(qid, key).agg(F.min(place).alias("first"), F.sort_array(F.collect_list(F.struct(place, chunk))).alias("h"))
    lists = lists.select(qid, key, "first", F.col(f"h.{chunk}").alias("chunks"))
    return lists.join(documents.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def first_by_flags(rows: DataFrame, flags: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows: those with the first flag, then with the second and so on, then in the given order."""
    return rows.orderBy(*[F.coalesce(F.col(f), F.lit(False)).desc() for f in flags], *order).limit(most)


def select_chunks(chunks: DataFrame, key: str, index: str, content: str, score: Column, reference: Column, most: int, least: int = 3) -> DataFrame:
    """Chunks of a document with a positive score, best first by (score, length, lower index), `most` at most.

    Where fewer than `least` have one, the best of the others that are no reference lists fill up. Blank chunks never count.
    """
    rows = chunks.where(~blank(F.col(content))).withColumn("score", score).withColumn("positive", F.col("score") > 0).withColumn("reference", reference)
    rows = rows.where("positive OR NOT reference")
    best = Window.partitionBy(key, "positive").orderBy(F.desc("score"), F.length(content).desc(), index)
    rows = rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    found = rows.withColumn("found", F.count_if("positive").over(Window.partitionBy(key)))
    return found.where(F.col("positive") | (F.col("place") <= min(least, most) - F.col("found"))).drop("place", "found", "reference")


def not_synced(rows: DataFrame, held: DataFrame, key: str, metadata: str, path: str) -> DataFrame:
    """Rows whose id stands in no held record's metadata (JSON)."""
    ids = held.select(F.get_json_object(metadata, path).alias(key)).where(F.col(key).isNotNull()).distinct()
    return rows.withColumn("_id", F.col(key).cast("string")).join(ids.withColumnRenamed(key, "_id"), "_id", "left_anti").drop("_id")


def predictions_by_document(parts: dict[str, DataFrame], key: str, item: str, order: str, caps: dict[str, int]) -> DataFrame:
    """One row for each document with a column for each kind: its distinct items in their order, as many as the kind's cap, joined by "; "."""
    long = reduce(DataFrame.unionByName, [df.select(key, F.lit(kind).alias("kind"), F.col(item).cast("string").alias("item"), F.col(order).cast("long").alias("at")) for kind, df in parts.items()])
    once = long.where(~blank(F.col("item"))).groupBy(key, "kind", "item").agg(F.min("at").alias("at"))
    once = once.withColumn("place", F.row_number().over(Window.partitionBy(key, "kind").orderBy("at", "item")))
    once = once.where(reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("place") <= n) for k, n in caps.items()]))
    listed = lambda k: F.concat_ws("; ", F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "item")))).getField("item")).alias(k)
    return once.groupBy(key).agg(*[listed(k) for k in caps])


def prediction_score(documents: DataFrame, items: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """documents: key, name, control; items: key, kind (projected or raw), item; gold: item, n. Adds n_projected, n_raw, n_rare, score.

    Two points for each of up to four classes (or two for raw items alone), one for each of up to three raw items beyond them,
    two for a name, three for controls, two for each of up to three classes that the gold set has once at most.
    """
    once = items.where(~blank(F.col("item"))).select(key, "kind", "item").distinct()
    rare = once.join(gold, "item", "left").withColumn("rare", (F.col("kind") == "projected") & (F.coalesce("n", F.lit(0)) <= 1))
    n = rare.groupBy(key).agg(F.count_if(F.col("kind") == "projected").alias("n_projected"), F.count_if(F.col("kind") == "raw").alias("n_raw"), F.count_if("rare").alias("n_rare"))
    d = documents.join(n, key, "left").fillna(0, ["n_projected", "n_raw", "n_rare"])
    p, r = F.col("n_projected"), F.col("n_raw")
    base = F.when(p > 0, F.least(p, F.lit(4)) * 2).when(r > 0, 2).otherwise(0)
    extra = F.least(F.greatest(r - p, F.lit(0)), F.lit(3)) + F.least(F.col("n_rare"), F.lit(3)) * 2
    return d.withColumn("score", (base + extra + F.when(blank(F.col("name")), 0).otherwise(2) + F.when(blank(F.col("control")), 0).otherwise(3)).cast("long"))


def source_errors(required: list[str], not_negative: list[str]) -> Column:
    """What is wrong with a record, in the order of the columns given: missing_<c> where blank, negative_<c> where below 0."""
    wrong = [F.when(blank(F.col(c)), F.lit(f"missing_{c}")) for c in required] + [F.when(F.col(c) < 0, F.lit(f"negative_{c}")) for c in not_negative]
    return F.array_compact(F.array(*wrong))


def pattern_confidence(n: Column) -> Column:
    return F.when(n < 10, 0.3).when(n < 50, 0.6).when(n < 100, 0.8).otherwise(0.9)


def missing_report(queries: DataFrame, run: DataFrame, qrels: DataFrame, methods: list[str], preview: int = 8) -> DataFrame:
    """For each method (and "qrels"): how many queries it has nothing for, and the first of them in their order."""
    asked = queries.select("qid").distinct().withColumn("method", F.explode(F.array(*[F.lit(m) for m in [*methods, "qrels"]])))
    have = run.select("method", "qid").unionByName(qrels.select(F.lit("qrels").alias("method"), "qid")).distinct()
    gone = asked.join(have, ["method", "qid"], "left_anti")
    n = gone.groupBy("method").agg(F.count("*").alias("n_missing"))
    first = gone.withColumn("place", F.row_number().over(Window.partitionBy("method").orderBy("qid"))).where(F.col("place") <= preview)
    first = first.groupBy("method").agg(F.concat_ws(", ", F.sort_array(F.collect_list("qid")).cast("array<string>")).alias("preview"))
    return n.join(first, "method").withColumn("preview", F.concat("preview", F.when(F.col("n_missing") > preview, "...").otherwise("")))


def ablation_table(rows: DataFrame, field: str, run: str, runs: list[str], right: Column) -> DataFrame:
    """A row for each field, for each run its share of right rows, and each later run's difference from the first."""
    n = rows.groupBy(field).agg(*[share(F.count_if(right & (F.col(run) == r)), F.count_if(F.col(run) == r)).alias(r) for r in runs])
    return n.select("*", *[(F.col(r) - F.col(runs[0])).alias(f"delta_{r}") for r in runs[1:]])


def merge_judgements(existing: DataFrame, annotated: DataFrame, label: str) -> DataFrame:
    """Judgements held, and under them the annotated rows with a positive label."""
    new = annotated.where(_spelling(F.col(label)).isin(POSITIVE)).select("qid", "doc_id", F.lit("yes").alias("is_relevant"), F.lit("annotated").alias("origin"))
    return existing.select("qid", "doc_id", "is_relevant", F.lit("held").alias("origin")).unionByName(new)


def expansion_rows(run: DataFrame, documents: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """qid, rank, doc_id, title and judged for the k best documents of each query; each document counts by its best score."""
    best = run.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    named = top.join(documents.select("doc_id", "title"), "doc_id", "left")
    known = qrels.select("qid", "doc_id").distinct().withColumn("judged", F.lit(True))
    return named.join(known, ["qid", "doc_id"], "left").withColumn("judged", F.coalesce("judged", F.lit(False)))


def name_issue(predicted: Column, gold: Column) -> Column:
    p, g = strip(F.coalesce(predicted, F.lit(""))), strip(F.coalesce(gold, F.lit("")))
    many = F.when(p.contains(";"), "multi_sample_or_scope_mismatch").otherwise("naming_convention_mismatch")
    return F.when(p == g, "no_issue").when(g == "", "gold_empty_policy_vs_predicted_name").otherwise(many)


def analysis_confidence(record: Column, sections: list[str]) -> Column:
    """Mean over the sections of a JSON record (0.8 a filled object or list, 0.3 another value, 0.1 nothing) and of 0.1 or 0.9 for an error or none."""

    def part(name: str) -> Column:
        v = strip(F.coalesce(F.get_json_object(record, f"$.{name}"), F.lit("")))
        return F.when(v.isin("", "{}", "[]", "0", "false"), 0.1).when(v.rlike(r"^[\[{]"), 0.8).otherwise(0.3)

    parts = [part(s) for s in sections] + [F.when(F.get_json_object(record, "$.error").isNotNull(), 0.1).otherwise(0.9)]
    return reduce(lambda a, b: a + b, parts) / len(parts)


def sync_check(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """One row: documents, chunks, documents with chunks, documents without, and chunks of no document."""
    n = chunks.groupBy(key).agg(F.count("*").alias("n"))
    both = documents.select(key).distinct().withColumn("held", F.lit(True)).join(n, key, "full")
    return both.agg(
        F.count("held").alias("n_documents"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"),
        F.count_if(F.col("held") & F.col("n").isNotNull()).alias("with_chunks"),
        F.count_if(F.col("held") & F.col("n").isNull()).alias("without_chunks"),
        F.coalesce(F.sum(F.when(F.col("held").isNull(), F.col("n"))), F.lit(0)).alias("orphan_chunks"),
    )


def uploads(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, sha1, state and parent: of files with equal content that with the least key is canonical, others are its children; no content: invalid.

    Only digests with copies are joined, so that files without any aren't exchanged for it.
    """
    f = files.select(key, F.sha1(F.col(content).cast("binary")).alias("sha1"))
    copies = f.where("sha1 IS NOT NULL").groupBy("sha1").agg(F.min(key).alias("parent"), F.count("*").alias("n")).where("n > 1").drop("n")
    j = f.join(copies, "sha1", "left").withColumn("parent", F.when(F.col("parent") != F.col(key), F.col("parent")))
    return j.withColumn("state", F.when(F.col("sha1").isNull(), "invalid").when(F.col("parent").isNull(), "canonical").otherwise("child"))


def stage_throughput(rows: DataFrame, stage: str, seconds: str) -> DataFrame:
    """For each stage: runs, 50th and 95th percentile of seconds, and the mean of documents a minute over runs that took any time."""
    s = F.col(seconds)
    return rows.groupBy(stage).agg(F.count("*").alias("n"), F.percentile(s, 0.5).alias("p50"), F.percentile(s, 0.95).alias("p95"), F.avg(F.when(s > 0, 60.0 / s)).alias("per_minute"))


def audit_picks(rows: DataFrame, key: str, text: str, weights: list[tuple[str, int]], topics: dict[str, str], each: int, most: int) -> DataFrame:
    """Scores rows by the patterns they hold; takes the `each` best of every topic, then the best of the rest, `most` in all."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    scored = rows.select(key, reduce(lambda a, b: a + b, [F.when(t.rlike(p), w).otherwise(0) for p, w in weights]).cast("long").alias("score"), F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in topics.items()])).alias("topics"))
    per = scored.select(key, "score", F.explode("topics").alias("topic"))
    per = per.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), key))).where(F.col("place") <= each)
    picked = per.groupBy(key).agg(F.lit(True).alias("for_topic"))
    all_rows = scored.drop("topics").join(picked, key, "left").withColumn("for_topic", F.coalesce("for_topic", F.lit(False)))
    return all_rows.orderBy(F.desc("for_topic"), F.desc("score"), key).limit(most)
