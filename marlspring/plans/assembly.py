"""Skip rules, joins of hits, picks, scores and uploads over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspring.functions.scalars import q6
from marlspring.operators import assembly as A
from marlspring.operators.text import chunks
from marlspring.plans.text import CHUNKS
from marlspring.registry import register
from marlspring.session import table

P = "floor(({}) * 1000000 + 0.5)::BIGINT"
SKIP = "CASE o_orderpriority WHEN '1-URGENT' THEN ' Yes ' WHEN '2-HIGH' THEN 'no' WHEN '3-MEDIUM' THEN 'maybe' END"
SCOPE = "CASE o_orderstatus WHEN 'F' THEN 'FALSE' WHEN 'O' THEN 'y' END"
SKIPPED = "(o_orderpriority = '1-URGENT' OR o_orderstatus = 'F')"


def _skip_orders(spark, sf):
    return table(spark, sf, "orders").withColumn("skipped", A.skipped(F.expr(SKIP), F.expr(SCOPE)))


@register("skip_rule", f"SELECT o_orderkey, {SKIPPED} AS skipped FROM orders")
def skip_rule(spark, sf):
    return _skip_orders(spark, sf).select("o_orderkey", "skipped")


@register("coverage_rate", f"SELECT o_orderpriority, count(*) AS total_rows, count(*) FILTER (NOT {SKIPPED}) AS evaluated_rows, count(*) FILTER (WHERE {SKIPPED}) AS skipped_rows, {P.format(f'count(*) FILTER (NOT {SKIPPED}) / count(*)::DOUBLE')} AS coverage_rate FROM orders GROUP BY 1")
def coverage_rate(spark, sf):
    return A.coverage(_skip_orders(spark, sf), F.col("skipped"), ["o_orderpriority"]).withColumn("coverage_rate", q6(F.col("coverage_rate")))


@register(
    "results_to_documents",
    """WITH h AS (SELECT l_orderkey AS qid, l_partkey AS p_partkey, min(l_linenumber) AS "first", string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_linenumber, l_suppkey) AS chunks FROM lineitem GROUP BY 1, 2)
    SELECT qid, h.p_partkey, "first", chunks, p_name, p_name IS NOT NULL AS found FROM h LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON p.p_partkey = h.p_partkey""",
)
def results_to_documents(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("p_partkey"), "l_linenumber", "l_suppkey")
    parts = table(spark, sf, "part").where("p_size > 5").select("p_partkey", "p_name")
    return A.results_to_documents(hits, parts, "qid", "p_partkey", "l_linenumber", "l_suppkey").withColumn("chunks", F.concat_ws(",", F.col("chunks").cast("array<string>")))


@register(
    "annotation_priority",
    """SELECT d.doc_id, l.doc_id IS NOT NULL AS annotated, coalesce(toxic = 1, false) AS predicted, coalesce(contains(lower(text), 'contamin') OR contains(lower(text), 'license'), false) AS domain_hit
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 DESC LIMIT 200""",
)
def annotation_priority(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", "toxic", F.lit(True).alias("a"))
    hit = F.lower("text").contains("contamin") | F.lower("text").contains("license")
    no = F.lit(False)
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(hit, no).alias("domain_hit")).join(l, "doc_id", "left")
    d = d.select("doc_id", F.coalesce("a", no).alias("annotated"), F.coalesce(F.col("toxic") == 1, no).alias("predicted"), "domain_hit")
    return A.first_by_flags(d, ["annotated", "predicted", "domain_hit"], [F.desc("doc_id")], 200)


@register(
    "chunk_selection",
    f"""WITH {CHUNKS}, s AS (SELECT doc_id, chunk_index, length(content) AS n, (length(content) - length(replace(content, 'an', ''))) // 2 - 6 AS score, contains(content, 'th') AS ref FROM chunks WHERE trim(content) <> ''),
    r AS (SELECT *, score > 0 AS positive, row_number() OVER (PARTITION BY doc_id, score > 0 ORDER BY score DESC, n DESC, chunk_index) AS place FROM s WHERE score > 0 OR NOT ref),
    f AS (SELECT *, count(*) FILTER (positive) OVER (PARTITION BY doc_id) AS found FROM r WHERE place <= 4)
    SELECT doc_id, chunk_index, score, positive FROM f WHERE positive OR place <= 3 - found""",
)
def chunk_selection(spark, sf):
    n = F.floor((F.length("content") - F.length(F.replace("content", F.lit("an"), F.lit("")))) / 2) - 6
    picked = A.select_chunks(chunks(table(spark, sf, "documents")), "doc_id", "chunk_index", "content", n, F.col("content").contains("th"), 4)
    return picked.select("doc_id", "chunk_index", "score", "positive")


@register("to_sync", "SELECT p_partkey FROM part WHERE p_partkey::VARCHAR NOT IN (SELECT regexp_extract(props, '\"k\": *([0-9]+)', 1) FROM events WHERE props IS NOT NULL)")
def to_sync(spark, sf):
    return A.not_synced(table(spark, sf, "part"), table(spark, sf, "events"), "p_partkey", "props", "$.k").select("p_partkey")


@register(
    "predictions_by_document",
    """WITH u AS (SELECT o_custkey AS doc, 'priority' AS kind, o_orderpriority AS item, o_orderkey AS pos FROM orders UNION ALL SELECT o_custkey, 'status', o_orderstatus, o_orderkey FROM orders
    UNION ALL SELECT c_custkey, 'segment', c_mktsegment, 0 FROM customer UNION ALL SELECT user_id, 'event', event_type, event_id FROM events),
    o AS (SELECT doc, kind, item, min(pos) AS pos FROM u WHERE trim(item) <> '' GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY pos, item) AS place FROM o)
    SELECT doc, coalesce(string_agg(item, '; ' ORDER BY place) FILTER (kind = 'priority' AND place <= 3), '') AS priority, coalesce(string_agg(item, '; ' ORDER BY place) FILTER (kind = 'status' AND place <= 2), '') AS status,
    coalesce(string_agg(item, '; ' ORDER BY place) FILTER (kind = 'segment' AND place <= 1), '') AS segment, coalesce(string_agg(item, '; ' ORDER BY place) FILTER (kind = 'event' AND place <= 3), '') AS event FROM r GROUP BY 1""",
)
def predictions_by_document(spark, sf):
    o, c, e = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "events")
    long = lambda df, doc, item, at: df.select(F.col(doc).alias("doc"), F.col(item).alias("item"), at.alias("at"))
    parts = {
        "priority": long(o, "o_custkey", "o_orderpriority", F.col("o_orderkey")),
        "status": long(o, "o_custkey", "o_orderstatus", F.col("o_orderkey")),
        "segment": long(c, "c_custkey", "c_mktsegment", F.lit(0)),
        "event": long(e, "user_id", "event_type", F.col("event_id")),
    }
    return A.predictions_by_document(parts, "doc", "item", "at", {"priority": 3, "status": 2, "segment": 1, "event": 3})


@register(
    "prediction_score",
    """WITH i AS (SELECT l_orderkey AS k, p_brand, p_name, p_size FROM lineitem JOIN part ON p_partkey = l_partkey), g AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size = 50 GROUP BY 1),
    p AS (SELECT k, count(*) AS n_projected, count(*) FILTER (coalesce(n, 0) <= 1) AS n_rare FROM (SELECT DISTINCT k, p_brand FROM i WHERE p_size < 25) LEFT JOIN g USING (p_brand) GROUP BY 1),
    r AS (SELECT k, count(DISTINCT p_name) AS n_raw FROM i GROUP BY 1),
    d AS (SELECT o_orderkey, o_orderstatus <> 'P' AS named, o_orderpriority = '1-URGENT' AS control, coalesce(n_projected, 0) AS n_projected, coalesce(n_raw, 0) AS n_raw, coalesce(n_rare, 0) AS n_rare FROM orders LEFT JOIN p ON p.k = o_orderkey LEFT JOIN r ON r.k = o_orderkey)
    SELECT o_orderkey, n_projected, n_raw, n_rare, (CASE WHEN n_projected > 0 THEN least(n_projected, 4) * 2 WHEN n_raw > 0 THEN 2 ELSE 0 END + least(greatest(n_raw - n_projected, 0), 3) + least(n_rare, 3) * 2 + CASE WHEN named THEN 2 ELSE 0 END + CASE WHEN control THEN 3 ELSE 0 END)::BIGINT AS score FROM d""",
)
def prediction_score(spark, sf):
    part = table(spark, sf, "part")
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    items = i.where("p_size < 25").select("o_orderkey", F.lit("projected").alias("kind"), F.col("p_brand").alias("item")).unionByName(i.select("o_orderkey", F.lit("raw").alias("kind"), F.col("p_name").alias("item")))
    gold = part.where("p_size = 50").groupBy(F.col("p_brand").alias("item")).agg(F.count("*").alias("n"))
    d = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("name"), F.when(F.col("o_orderpriority") == "1-URGENT", "x").alias("control"))
    return A.prediction_score(d, items, gold, "o_orderkey").drop("name", "control")


@register("source_errors", "WITH c AS (SELECT *, concat_ws(',', CASE WHEN c_mktsegment = 'MACHINERY' THEN 'missing_kind' END, CASE WHEN c_acctbal < 0 THEN 'negative_c_acctbal' END) AS errors FROM customer) SELECT c_custkey, errors, errors = '' AS valid FROM c")
def source_errors(spark, sf):
    c = table(spark, sf, "customer").withColumn("kind", F.when(F.col("c_mktsegment") == "MACHINERY", " ").otherwise(F.col("c_mktsegment")))
    c = c.withColumn("e", A.source_errors(["c_name", "kind"], ["c_acctbal"]))
    return c.select("c_custkey", F.concat_ws(",", "e").alias("errors"), (F.size("e") == 0).alias("valid"))


@register("pattern_confidence", f"SELECT user_id, event_type, count(*) AS n, {P.format('CASE WHEN count(*) < 10 THEN 0.3 WHEN count(*) < 50 THEN 0.6 WHEN count(*) < 100 THEN 0.8 ELSE 0.9 END')} AS confidence FROM events GROUP BY 1, 2")
def pattern_confidence(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("confidence", q6(A.pattern_confidence(F.col("n"))))


@register(
    "missing_report",
    """WITH g AS (SELECT m AS method, c_custkey AS qid FROM customer, (SELECT unnest(['error', 'view', 'qrels']) AS m) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = t.m AND e.user_id = c_custkey) AND NOT (m = 'qrels' AND c_custkey IN (SELECT doc_id FROM labels)))
    SELECT method, count(*) AS n_missing, array_to_string(list_sort(list(qid))[1:8], ', ') || CASE WHEN count(*) > 8 THEN '...' ELSE '' END AS preview FROM g GROUP BY 1""",
)
def missing_report(spark, sf):
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"))
    run = table(spark, sf, "events").select(F.col("event_type").alias("method"), F.col("user_id").alias("qid"))
    return A.missing_report(q, run, table(spark, sf, "labels").select(F.col("doc_id").alias("qid")), ["error", "view"])


@register(
    "ablation_table",
    f"""WITH n AS (SELECT l_linenumber, {", ".join(f"coalesce(count(*) FILTER (l_returnflag = '{r}' AND l_quantity > 25) / nullif(count(*) FILTER (l_returnflag = '{r}'), 0)::DOUBLE, 0) AS {r}" for r in "ANR")} FROM lineitem GROUP BY 1)
    SELECT l_linenumber, {P.format("A")} AS a, {P.format("N")} AS n, {P.format("R")} AS r, {P.format("N - A")} AS delta_n, {P.format("R - A")} AS delta_r FROM n""",
)
def ablation_table(spark, sf):
    t = A.ablation_table(table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", ["A", "N", "R"], F.col("l_quantity") > 25)
    return t.select("l_linenumber", *[q6(F.col(c)).alias(c.lower()) for c in t.columns[1:]])


@register("merged_judgements", "SELECT 0::BIGINT AS qid, doc_id, CASE WHEN quality > 0 THEN 'yes' ELSE 'no' END AS is_relevant, 'held' AS origin FROM labels UNION ALL SELECT o_custkey, o_orderkey, 'yes', 'annotated' FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def merged_judgements(spark, sf):
    held = table(spark, sf, "labels").select(F.lit(0).cast("long").alias("qid"), "doc_id", F.when(F.col("quality") > 0, "yes").otherwise("no").alias("is_relevant"))
    said = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN ' YES' WHEN '2-HIGH' THEN 'Relevant' WHEN '5-LOW' THEN 'no' END")
    return A.merge_judgements(held, table(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("doc_id"), said.alias("label")), "label")


@register(
    "expansion_rows",
    """WITH b AS (SELECT l_orderkey AS qid, l_partkey AS doc_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM b),
    j AS (SELECT DISTINCT l_orderkey AS qid, l_partkey AS doc_id FROM lineitem WHERE l_returnflag = 'R')
    SELECT r.qid, r.doc_id, score, rank, p_name AS title, j.qid IS NOT NULL AS judged FROM r LEFT JOIN part ON p_partkey = r.doc_id LEFT JOIN j ON j.qid = r.qid AND j.doc_id = r.doc_id WHERE rank <= 3""",
)
def expansion_rows(spark, sf):
    run = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc_id"), F.col("l_extendedprice").alias("score"), "l_returnflag")
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    return A.expansion_rows(run, docs, run.where("l_returnflag = 'R'"), 3)


@register("name_issues", "WITH n AS (SELECT p_partkey, CASE WHEN p_size < 20 THEN p_name ELSE p_name || '; ' || p_brand END AS p, CASE WHEN p_size < 10 THEN '' WHEN p_size < 30 THEN p_name ELSE p_brand END AS g FROM part) SELECT p_partkey, CASE WHEN p = g THEN 'no_issue' WHEN g = '' THEN 'gold_empty_policy_vs_predicted_name' WHEN contains(p, ';') THEN 'multi_sample_or_scope_mismatch' ELSE 'naming_convention_mismatch' END AS issue FROM n")
def name_issues(spark, sf):
    p = F.expr("CASE WHEN p_size < 20 THEN p_name ELSE p_name || '; ' || p_brand END")
    g = F.expr("CASE WHEN p_size < 10 THEN ' ' WHEN p_size < 30 THEN p_name ELSE p_brand END")
    return table(spark, sf, "part").select("p_partkey", A.name_issue(p, g).alias("issue"))


RECORD = """concat('{"meteorite_data": ', CASE event_type WHEN 'view' THEN '{}' ELSE props END, ', "organic_compounds": ', CASE WHEN value > 50 THEN '["x"]' ELSE '[]' END, ', "scientific_insights": "', CASE WHEN event_type = 'click' THEN 'text' ELSE '' END, '"', CASE WHEN event_type = 'error' THEN ', "error": "e"' ELSE '' END, '}')"""


@register(
    "analysis_confidence",
    f"SELECT event_id, {P.format('(CASE WHEN event_type = ' + chr(39) + 'view' + chr(39) + ' OR props IS NULL THEN 0.1::DOUBLE ELSE 0.8::DOUBLE END + CASE WHEN value > 50 THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN event_type = ' + chr(39) + 'click' + chr(39) + ' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN event_type = ' + chr(39) + 'error' + chr(39) + ' THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END) / 4')} AS confidence FROM events",
)
def analysis_confidence(spark, sf):
    return table(spark, sf, "events").select("event_id", q6(A.analysis_confidence(F.expr(RECORD), ["meteorite_data", "organic_compounds", "scientific_insights"])).alias("confidence"))


@register(
    "sync_check",
    f"""WITH {CHUNKS}, n AS (SELECT doc_id, count(*) AS n FROM chunks WHERE length(content) > 400 GROUP BY 1), j AS (SELECT l.doc_id AS held, n FROM labels l FULL JOIN n ON n.doc_id = l.doc_id)
    SELECT count(held) AS n_documents, coalesce(sum(n), 0)::BIGINT AS n_chunks, count(*) FILTER (held IS NOT NULL AND n IS NOT NULL) AS with_chunks, count(*) FILTER (held IS NOT NULL AND n IS NULL) AS without_chunks, coalesce(sum(n) FILTER (held IS NULL), 0)::BIGINT AS orphan_chunks FROM j""",
)
def sync_check(spark, sf):
    return A.sync_check(table(spark, sf, "labels"), chunks(table(spark, sf, "documents")).where(F.length("content") > 400), "doc_id")


@register("uploads", "WITH f AS (SELECT doc_id, sha1(text) AS sha1, min(doc_id) OVER (PARTITION BY text) AS m FROM documents) SELECT doc_id, sha1, CASE WHEN sha1 IS NOT NULL AND m <> doc_id THEN m END AS parent, CASE WHEN sha1 IS NULL THEN 'invalid' WHEN m = doc_id THEN 'canonical' ELSE 'child' END AS state FROM f")
def uploads(spark, sf):
    return A.uploads(table(spark, sf, "documents"), "doc_id", "text")


@register("stage_throughput", f"SELECT event_type, count(*) AS n, {P.format('quantile_cont(value, 0.5)')} AS p50, {P.format('quantile_cont(value, 0.95)')} AS p95, floor(avg(CASE WHEN value > 0 THEN 60.0 / value END) * 1000 + 0.5)::BIGINT AS per_minute FROM events GROUP BY 1")
def stage_throughput(spark, sf):
    t = A.stage_throughput(table(spark, sf, "events"), "event_type", "value")
    return t.select("event_type", "n", q6(F.col("p50")).alias("p50"), q6(F.col("p95")).alias("p95"), F.floor(F.col("per_minute") * 1000 + 0.5).alias("per_minute"))


@register(
    "audit_picks",
    """WITH s AS (SELECT p_partkey, (CASE WHEN regexp_matches(lower(p_name), 'ring|bolt') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(lower(p_name), 'small|large') THEN 4 ELSE 0 END)::BIGINT AS score, lower(p_name) AS n FROM part),
    t AS (SELECT p_partkey FROM (SELECT * FROM s WHERE regexp_matches(n, 'small') ORDER BY score DESC, p_partkey LIMIT 5) UNION SELECT p_partkey FROM (SELECT * FROM s WHERE regexp_matches(n, '^.{0,9}$') ORDER BY score DESC, p_partkey LIMIT 5))
    SELECT p_partkey, score, p_partkey IN (SELECT p_partkey FROM t) AS for_topic FROM s ORDER BY 3 DESC, 2 DESC, 1 LIMIT 60""",
)
def audit_picks(spark, sf):
    return A.audit_picks(table(spark, sf, "part"), "p_partkey", "p_name", [("ring|bolt", 6), ("small|large", 4)], {"small": "small", "short": "^.{0,9}$"}, 5, 60)
