"""Batch forms of the streaming operators, and sources written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspring.operators.text import chunks
from marlspring.plans.text import CHUNKS
from marlspring.registry import register
from marlspring.session import scratch, table
from marlspring.sources import files as S
from marlspring.sources.files import Collection
from marlspring.streaming import checkpoints as C
from marlspring.streaming import jobs as J

HOURLY = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5)::BIGINT AS cents FROM events GROUP BY 1, 2"


def _hours(h):
    return h.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.floor(F.col("sum_value") * 100 + 0.5).cast("long").alias("cents"))


@register("hourly_counts", HOURLY)
def hourly_counts(spark, sf):
    return _hours(J.hourly_counts(table(spark, sf, "events")))


@register("streamed_hourly_counts", HOURLY)
def streamed_hourly_counts(spark, sf):
    """The same by a stream that runs over the events' file and stops."""
    schema = table(spark, sf, "events").schema
    files = J.folder(spark, f"{sf}/events.parquet*", schema)
    target = scratch(spark)
    J.run_complete(J.hourly_counts(files), target, scratch(spark))
    return _hours(spark.read.parquet(target))


@register("frequent_users", "SELECT start, user_id, count(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL '10 minutes', ts) - INTERVAL (k * 10) MINUTE AS start FROM events, (SELECT unnest(range(6)) AS k)) GROUP BY 1, 2 HAVING count(*) > 1")
def frequent_users(spark, sf):
    return J.frequent_users(table(spark, sf, "events"), 1).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(
    "user_sessions",
    """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def user_sessions(spark, sf):
    s = J.user_sessions(table(spark, sf, "events"), "6 hours")
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@register("collection_scan", f"WITH {CHUNKS} SELECT doc_id, chunk_index::BIGINT AS chunk_index FROM chunks ORDER BY doc_id, chunk_index LIMIT 25 OFFSET 50")
def collection_scan(spark, sf):
    c = Collection(spark, scratch(spark))
    c.insert(chunks(table(spark, sf, "documents")))
    return c.scan(25, 50).select("doc_id", "chunk_index")


@register("collection_delete", "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE doc_id % 3 > 0")
def collection_delete(spark, sf):
    c = Collection(spark, scratch(spark))
    d = table(spark, sf, "documents")
    c.insert(d.select("doc_id", F.lit(0).alias("chunk_index"), F.length("text").cast("long").alias("n")))
    c.delete(d.where("doc_id % 3 = 0"))
    return c.scan().select("doc_id", "n")


@register("collection_of_document", f"WITH {CHUNKS} SELECT doc_id, chunk_index::BIGINT AS chunk_index, md5(content) AS digest FROM chunks WHERE doc_id = 7")
def collection_of_document(spark, sf):
    c = Collection(spark, scratch(spark))
    c.insert(chunks(table(spark, sf, "documents")))
    return c.of_document(7).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@register("collection_count", f"WITH {CHUNKS} SELECT count(*) AS n, 0::BIGINT AS lost FROM chunks")
def collection_count(spark, sf):
    """Chunks inserted, moved to a second collection, and counted there."""
    a, b = Collection(spark, scratch(spark)), Collection(spark, scratch(spark))
    a.insert(chunks(table(spark, sf, "documents")))
    return a.migrate(b).agg(F.count("*").alias("lost")).crossJoin(b.scan().agg(F.count("*").alias("n"))).select("n", "lost")  # one row each


@register("queries_file", "SELECT item_id::VARCHAR AS qid, text AS question FROM benchmark")
def queries_file(spark, sf):
    """Questions written as JSON lines, with blank lines between, and read back."""
    path = scratch(spark)
    b = table(spark, sf, "benchmark").select(F.to_json(F.struct(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"))).alias("value"))
    b.select(F.concat("value", F.lit("\n")).alias("value")).write.text(path)
    return S.read_queries(spark, path)


@register("qrels_file", "SELECT DISTINCT l_orderkey::VARCHAR AS qid, l_partkey::VARCHAR AS doc_id, (l_partkey % 3)::INT AS relevance FROM lineitem")
def qrels_file(spark, sf):
    """Judgments written as CSV, repeats included, and read back."""
    path = scratch(spark)
    table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc_id"), (F.col("l_partkey") % 3).alias("relevance")).write.option("header", True).csv(path)
    return S.read_qrels(spark, path)


@register("runs_file", "SELECT o_custkey::VARCHAR AS qid, o_orderkey::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS rank FROM orders")
def runs_file(spark, sf):
    """Runs of a list for each query, under other names of the fields and without ranks, read back."""
    path = scratch(spark)
    hits = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.struct(k.cast("string").alias("document_id")))
    table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("query_id")).agg(hits.alias("hits")).write.json(path)
    return S.read_runs(spark, path).select("qid", "doc_id", F.col("rank").cast("int").alias("rank"))


@register("gold_file", "SELECT p_partkey::VARCHAR AS doc_id, p_name AS name, p_brand AS brand, NULL::VARCHAR AS note FROM part")
def gold_file(spark, sf):
    path = scratch(spark)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("\ufeffdoc_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("more"))
    p.write.option("header", True).csv(path)
    return S.read_gold(spark, path, ["doc_id", "name"], ["brand", "note"])


@register("csv_sink", "SELECT c_custkey::VARCHAR AS c_custkey, printf('%.4f', c_acctbal) AS c_acctbal, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS segment FROM customer")
def csv_sink(spark, sf):
    """Fixed column order and digits, nulls empty; read back as text."""
    path = scratch(spark)
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_custkey")
    S.write_csv(c, path, ["c_custkey", "c_acctbal", "segment"], 4)
    return spark.read.option("header", True).csv(path)


@register("appended_log", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def appended_log(spark, sf):
    """Events appended by two writers as JSON lines, read back and counted."""
    path, e = scratch(spark), table(spark, sf, "events").select("event_id", "event_type")
    S.append_log(e.where("event_id % 2 = 0"), path)
    S.append_log(e.where("event_id % 2 = 1"), path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@register("resumed_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def resumed_stream(spark, sf):
    """The events' file as a stream that is run twice with one checkpoint: the second run finds nothing new."""
    files = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*").select("event_id", "event_type")
    target, checkpoint = scratch(spark), scratch(spark)
    for _ in range(2):
        J.run_once(files, target, checkpoint)
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"))


@register(
    "checkpoint_statistics",
    """WITH d AS (SELECT event_type AS task, ts::DATE AS day, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS created_at, count(*) AS done FROM events GROUP BY 1, 2),
    k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY task ORDER BY day DESC) <= 20), s AS (SELECT task, count(*) AS n, max(created_at) AS latest, sum(length('{"created_at":"' || created_at || '","done":' || done || '}') + 1)::BIGINT AS size, arg_max(done, day) AS done FROM k GROUP BY 1)
    SELECT task, true AS has_checkpoints, n AS checkpoints, latest AS latest_time, size AS total_size, done FROM s UNION ALL SELECT 'none', false, 0, NULL, 0, NULL""",
)
def checkpoint_statistics(spark, sf):
    """A checkpoint a day for each type of event; twenty are kept. A task without any is asked for too."""
    e, base = table(spark, sf, "events"), scratch(spark)
    day = F.datediff(F.to_date("ts"), F.lit("2000-01-01").cast("date")).cast("long")
    C.write(e.groupBy(F.col("event_type").alias("task"), day.alias("version")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.count("*").alias("done")), base)
    C.prune(spark, base)
    tasks = e.select(F.col("event_type").alias("task")).distinct().union(spark.range(1).select(F.lit("none")))
    done = C.latest(spark, base, "created_at string, done long").select("task", "done")
    return C.statistics(spark, base, tasks).join(done, "task", "left").select("task", "has_checkpoints", "checkpoints", "latest_time", "total_size", "done")
