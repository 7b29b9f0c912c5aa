"""Comparisons, picks, queues and evidence over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspring.functions.scalars import q6
from marlspring.operators import listing as G
from marlspring.operators.text import chunks, clean_title
from marlspring.plans.retrieval import CHUNK_HITS, _chunk_hits
from marlspring.plans.text import CHUNKS
from marlspring.registry import register
from marlspring.session import table

P = "floor(({}) * 1000000 + 0.5)::BIGINT"


@register("allowed_only", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def allowed_only(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return G.allowed_only(table(spark, sf, "orders"), c, "o_custkey").select("o_orderkey")


@register("before_after", "SELECT lang, coalesce(b, 0) AS before, coalesce(a, 0) AS after, coalesce(a, 0) - coalesce(b, 0) AS delta FROM (SELECT lang, count(*) AS b FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) FULL JOIN (SELECT lang, count(*) AS a FROM documents WHERE n_chars > 2000 GROUP BY 1) USING (lang)")
def before_after(spark, sf):
    d = table(spark, sf, "documents")
    n = lambda df: df.groupBy("lang").agg(F.count("*").alias("n"))
    return G.before_after(n(d.where("doc_id % 2 = 0")), n(d.where("n_chars > 2000")), "lang", "n")


@register(
    "relevance_match",
    "WITH j AS (SELECT p_partkey, p_name, p_size % 3 AS relevance FROM part WHERE p_partkey % 4 = 0), n AS (SELECT lower(p_name) AS k, max(relevance) AS r FROM j GROUP BY 1) SELECT p.p_partkey, coalesce(j.relevance, n.r, 0) AS relevance FROM part p LEFT JOIN j ON j.p_partkey = p.p_partkey LEFT JOIN n ON n.k = lower(p.p_name)",
)
def relevance_match(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    j = table(spark, sf, "part").where("p_partkey % 4 = 0").select("p_partkey", "p_name", (F.col("p_size") % 3).alias("relevance"))
    return G.relevance_by_id_or_name(p, j, "p_partkey", "p_name").select("p_partkey", "relevance")


@register("last_source", "WITH u AS (SELECT o_custkey AS k, o_orderstatus AS v, o_orderkey * 2 AS p, 'orders' AS source FROM orders UNION ALL SELECT c_custkey, c_mktsegment, c_custkey * 50 + 1, 'customer' FROM customer) SELECT k, arg_max(v, p) AS v, count(DISTINCT source) AS n_sources FROM u GROUP BY 1")
def last_source(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), (F.col("o_orderkey") * 2).alias("p"), F.lit("orders").alias("source"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), (F.col("c_custkey") * 50 + 1).alias("p"), F.lit("customer").alias("source"))
    return G.last_source(o.unionByName(c), "k", "v", "p")


@register(
    "set_comparison",
    """WITH a AS (SELECT p_type, list(DISTINCT p_brand) AS x FROM part WHERE p_size < 10 GROUP BY 1), b AS (SELECT p_type, list(DISTINCT p_brand) AS y FROM part WHERE p_size >= 10 GROUP BY 1),
    j AS (SELECT p_type, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a FULL JOIN b USING (p_type)), s AS (SELECT *, len(list_intersect(x, y)) AS i FROM j)
    SELECT p_type, len(x) AS n_a, len(y) AS n_b, i AS "both", len(x) - i AS only_a, len(y) - i AS only_b, floor(coalesce(i / nullif(len(x) + len(y) - i, 0)::DOUBLE, 0) * 1000 + 0.5)::BIGINT AS jaccard_m, i = len(x) AND len(x) < len(y) AS subset FROM s""",
)
def set_comparison(spark, sf):
    p = table(spark, sf, "part")
    return G.set_comparison(p.where("p_size < 10"), p.where("p_size >= 10"), "p_type", "p_brand")


@register(
    "segment_candidates",
    f"""WITH {CHUNK_HITS}, g AS (SELECT qid, doc_id, max(s) AS s, arg_max(chunk_index, s * 100000 - chunk_index) AS best, list_sort(list(DISTINCT chunk_index)) AS c, list(length(content) ORDER BY rank) AS l, min(rank) AS first FROM ch GROUP BY 1, 2)
    SELECT qid, doc_id, s AS score, best::BIGINT AS best_chunk, array_to_string(c, ',') AS chunks, least(12000, list_sum(l[1:3]))::BIGINT AS chars, first FROM g""",
)
def segment_candidates(spark, sf):
    return G.segment_candidates(_chunk_hits(spark, sf)).withColumn("score", q6(F.col("score")))


@register("chunks_per_document", f"WITH {CHUNKS} SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def chunks_per_document(spark, sf):
    return chunks(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(20)


@register(
    "performance_trend",
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events), g AS (SELECT user_id, avg(value) FILTER (k <= 5) AS r, avg(value) FILTER (k > 5) AS e FROM k GROUP BY 1)
    SELECT user_id, {P.format("r")} AS recent, {P.format("e")} AS earlier, CASE WHEN e IS NULL THEN 'unknown' WHEN r > 1.1::DOUBLE * e THEN 'slower' WHEN r < 0.9::DOUBLE * e THEN 'faster' ELSE 'stable' END AS change FROM g""",
)
def performance_trend(spark, sf):
    t = G.recent_against_earlier(table(spark, sf, "events"), "user_id", [F.desc("event_id")], "value")
    return t.select("user_id", q6(F.col("recent")).alias("recent"), q6(F.col("earlier")).alias("earlier"), "change")


@register("typed_union", "SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'part', p_partkey FROM part WHERE contains(p_name, 'ring')")
def typed_union(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return o.unionByName(table(spark, sf, "part").where(F.col("p_name").contains("ring")).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id")))


@register("missing_ids", "SELECT i::BIGINT AS doc_id FROM range(990, 1010) t(i) WHERE i NOT IN (SELECT doc_id FROM documents)")
def missing_ids(spark, sf):
    return spark.range(990, 1010).select(F.col("id").alias("doc_id")).join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_anti")


@register("split_pages", "(SELECT 'approved' AS side, o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 5) UNION ALL (SELECT 'pending', o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 5)")
def split_pages(spark, sf):
    o = table(spark, sf, "orders")
    side = lambda name, s: o.where(F.col("o_orderstatus") == s).orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(5).select(F.lit(name).alias("side"), "o_orderkey")
    return side("approved", "F").union(side("pending", "O"))


@register(
    "picked_evidence",
    f"""WITH {CHUNK_HITS}, u AS (SELECT *, rank % 3 = 1 AS used FROM ch), d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, doc_id, chunk_index, left(content, 120) ORDER BY used DESC, rank) = 1)
    SELECT qid, doc_id, chunk_index::BIGINT AS chunk_index, row_number() OVER (PARTITION BY qid ORDER BY used DESC, rank, doc_id, chunk_index) AS place FROM d QUALIFY place <= 5""",
)
def picked_evidence(spark, sf):
    return G.pick_evidence(_chunk_hits(spark, sf).withColumn("used", F.col("rank") % 3 == 1), "qid", 5).select("qid", "doc_id", "chunk_index", "place")


@register("selection_overflow", "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS place, CASE WHEN place <= 10 THEN 'selected' ELSE 'overflow' END AS reason FROM part")
def selection_overflow(spark, sf):
    return G.select_with_reason(table(spark, sf, "part"), "p_type", [F.desc("p_retailprice"), F.col("p_partkey")], 10).select("p_partkey", "place", "reason")


@register("task_queue", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 30")
def task_queue(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'P'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(30).select("o_orderkey")


@register("recent_then_small", "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars FROM documents ORDER BY doc_id DESC LIMIT 100) ORDER BY n_chars, doc_id LIMIT 10")
def recent_then_small(spark, sf):
    return table(spark, sf, "documents").orderBy(F.desc("doc_id")).limit(100).orderBy("n_chars", "doc_id").limit(10).select("doc_id", "n_chars")


@register(
    "chunk_scores",
    rf"""WITH {CHUNKS}, s AS (SELECT doc_id, chunk_index, (2 * (len(regexp_extract_all(lower(content), '\bthe\b')) + len(regexp_extract_all(lower(content), '\bder\b'))) - chunk_index - CASE WHEN regexp_matches(content, '(?i)\b(references|bibliography|doi)\b') THEN 8 ELSE 0 END)::BIGINT AS score FROM chunks)
    SELECT doc_id, chunk_index::BIGINT AS chunk_index, score, CASE WHEN score > 0 THEN 'scored' ELSE 'fill' END AS pick FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score > 0 DESC, CASE WHEN score > 0 THEN -score ELSE chunk_index END, chunk_index) <= 3""",
)
def chunk_scores(spark, sf):
    return G.chunk_scores(chunks(table(spark, sf, "documents")), ["the", "der"])


@register("batch_action", "SELECT i::BIGINT AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'not_found' WHEN o_orderstatus = 'P' THEN 'done' ELSE 'not_allowed' END AS result FROM range(14900, 15100) t(i) LEFT JOIN orders o ON o.o_orderkey = i")
def batch_action(spark, sf):
    return G.batch_action(table(spark, sf, "orders"), spark.range(14900, 15100).select(F.col("id").alias("o_orderkey")), "o_orderkey", F.col("o_orderstatus") == "P")


@register(
    "shadowed_attempts",
    """WITH a AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]')) AS c FROM conversations), p AS (SELECT a.conv_id, a.turn, b.turn AS o, len(list_intersect(a.c, b.c)) AS i, len(a.c) AS n, len(b.c) AS m FROM a JOIN a b ON a.conv_id = b.conv_id AND b.turn < a.turn)
    SELECT conv_id, turn, o AS "by" FROM p WHERE i >= 4 AND i / n::DOUBLE >= 0.8 AND i / m::DOUBLE >= 0.8 AND n - i <= 1 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i DESC, o) = 1""",
)
def shadowed_attempts(spark, sf):
    a = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]"), F.lit(0))).alias("c"))
    return G.shadowed(a, "conv_id", "turn", "c")


@register("evidence_blocks", rf"WITH {CHUNK_HITS} SELECT qid, count(*) AS n, md5(string_agg('[s' || rank || '] doc ' || doc_id || ': ' || left(regexp_replace(content, '\s+', ' ', 'g'), 200), chr(10) ORDER BY rank)) AS digest FROM ch GROUP BY 1")
def evidence_blocks(spark, sf):
    return G.evidence_blocks(_chunk_hits(spark, sf)).select("qid", "n", F.md5("block").alias("digest"))


@register("in_text_citations", r"SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\[\d+(?:,\s*\d+)*\]') || regexp_extract_all(t, '\([A-Z][a-z]+(?: et al\.)?,? \d{4}\)'))), '|') AS cited FROM (SELECT p_partkey, p_name || ' [' || p_size || ', 3] and (Smith et al., ' || (1980 + p_size) || ') [' || p_size || ', 3]' AS t FROM part)")
def in_text_citations(spark, sf):
    t = F.concat("p_name", F.lit(" ["), "p_size", F.lit(", 3] and (Smith et al., "), F.col("p_size") + 1980, F.lit(") ["), "p_size", F.lit(", 3]"))
    return G.in_text_citations(table(spark, sf, "part").select("p_partkey", t.alias("t")), "p_partkey", "t")


@register("cache_eviction", "SELECT p_partkey, (p_size - p_partkey % 30)::BIGINT AS worth FROM part ORDER BY 2, 1 LIMIT (SELECT greatest(1, count(*) // 10) FROM part)")
def cache_eviction(spark, sf):
    return G.eviction(table(spark, sf, "part"), "p_partkey", F.col("p_size").cast("long"), F.col("p_partkey") % 30)


@register("chunk_size_sweep", "SELECT k::BIGINT AS chunk_tokens, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(0, ceil((length(text) - k * 4) / ((k - o) * 4.0))) + 1 END)::BIGINT AS n FROM documents, (SELECT unnest([500, 700, 900]) AS k, unnest([50, 80, 100]) AS o) GROUP BY 1")
def chunk_size_sweep(spark, sf):
    d, out = table(spark, sf, "documents"), None
    for k, o in ((500, 50), (700, 80), (900, 100)):
        n = chunks(d, chunk_tokens=k, overlap_tokens=o).agg(F.count("*").alias("n")).select(F.lit(k).cast("long").alias("chunk_tokens"), "n")
        out = n if out is None else out.union(n)
    return out


@register("token_windows")
def token_windows(spark, sf):
    return G.token_windows(table(spark, sf, "documents"), 200, 20).select("doc_id", "chunk_index", "start", F.md5("content").alias("digest"))


@register("mojibake_repair")
def mojibake_repair(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"))
    return G.repair_mojibake(d, "doc_id", "text")


@register("last_fields", "SELECT user_id, event_type, arg_max(props, event_id) AS props, count(*) AS n FROM events GROUP BY 1, 2")
def last_fields(spark, sf):
    return G.last_fields(table(spark, sf, "events"), "user_id", ["event_id"], "event_type", "props")


@register("normalized_turns", r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\p{L}\p{N}?]+', ' ', 'g'), ' ') AS normalized, len(regexp_extract_all(trim(regexp_replace(lower(text), '[^\p{L}\p{N}?]+', ' ', 'g'), ' '), '\S+'))::BIGINT AS n_tokens, contains(text, '?') AS asks FROM conversations")
def normalized_turns(spark, sf):
    return G.nlu(table(spark, sf, "conversations"))


@register("payload_schema", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS name FROM events")
def payload_schema(spark, sf):
    j = F.from_json("props", "struct<k:bigint,name:string>")
    return table(spark, sf, "events").select("event_id", j["k"].alias("k"), j["name"].alias("name"))


@register("error_summary", "SELECT user_id, count(*) AS n, array_to_string(list(event_id ORDER BY event_id DESC)[1:3], ',') AS last FROM events WHERE event_type = 'error' GROUP BY 1")
def error_summary(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    return G.counts_with_last(e, "user_id", "event_id", 3)


@register(
    "metadata_backfill",
    r"""WITH a AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS raw FROM pages),
    b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(raw, '\s+', ' ', 'g'), '^[\s.,;:_-]+|[\s,;:_-]+$', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM a)
    SELECT page_id, CASE WHEN lower(t) NOT IN ('', 'unknown', 'untitled', 'none', 'null', 'n/a') THEN left(t, 200) ELSE 'host ' || regexp_extract(url, '://([^/?#:]*)', 1) END AS title FROM b""",
)
def metadata_backfill(spark, sf):
    p = table(spark, sf, "pages").withColumn("t", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    return p.select("page_id", F.coalesce(clean_title(F.col("t")), F.concat(F.lit("host "), F.regexp_extract("url", "://([^/?#:]*)", 1))).alias("title"))


@register("shared_files", "SELECT sha1(text) AS digest, count(*) AS n, count(*) > 1 AS keep_file FROM documents GROUP BY 1")
def shared_files(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("n")).withColumn("keep_file", F.col("n") > 1)


@register("oldest_pending", "SELECT doc_id FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha1(text)) WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 20")
def oldest_pending(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    return d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(20).select("doc_id")


@register("success_rates", f"SELECT event_type, count(*) AS n, {P.format('avg(CASE WHEN value < 50 THEN 1.0 ELSE 0 END)')} AS rate, {P.format('avg(value)')} AS mean FROM events GROUP BY 1")
def success_rates(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.when(F.col("value") < 50, 1.0).otherwise(0.0)).alias("r"), F.avg("value").alias("m"))
    return e.select("event_type", "n", q6(F.col("r")).alias("rate"), q6(F.col("m")).alias("mean"))
