"""Catalog, set and lookup queries over parts, suppliers, customers, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspring.functions.scalars import q6
from marlspring.operators import catalog as K
from marlspring.registry import register
from marlspring.session import table

P = "floor(({}) * 1000000 + 0.5)::BIGINT"


@register("status_counts", "SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.counts_with_zeros(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@register("catalog_filter", "SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt')) AND p_type IN ('SMALL', 'PROMO') AND p_size BETWEEN 5 AND 30 AND p_retailprice >= 900")
def catalog_filter(spark, sf):
    return K.filter_catalog(table(spark, sf, "part"), {"p_name": ["ring", "Bolt"]}, {"p_type": ["SMALL", "PROMO"]}, {"p_size": (5, 30), "p_retailprice": (900.0, None)}).select("p_partkey")


@register("search_terms", "SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')) AND (contains(lower(p_name), '#1') OR contains(lower(p_brand), '#1') OR contains(lower(p_type), '#1'))")
def search_terms(spark, sf):
    return K.search_all_terms(table(spark, sf, "part"), "Red #1", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@register("weighted_search", f"SELECT p_partkey, {P.format('r')} AS match_rank FROM (SELECT p_partkey, CASE WHEN contains(lower(p_name), 'small') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(p_type), 'small') THEN 0.4 ELSE 0 END + CASE WHEN contains(lower(p_name), 'ring') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(p_type), 'ring') THEN 0.4 ELSE 0 END AS r FROM part) WHERE r > 0")
def weighted_search(spark, sf):
    return K.weighted_search(table(spark, sf, "part"), ["small", "ring"], {"p_name": 1.0, "p_type": 0.4}).select("p_partkey", q6(F.col("match_rank")).alias("match_rank"))


@register("paged_list", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def paged_list(spark, sf):
    return K.page(table(spark, sf, "part"), [F.desc("p_retailprice"), F.col("p_partkey")], 3, 20).select("p_partkey", "p_name")


@register("page_past_the_end", "SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 10 OFFSET (SELECT (greatest(1, ceil(count(*) / 10.0)) - 1)::BIGINT * 10 FROM nation)")
def page_past_the_end(spark, sf):
    return K.page(table(spark, sf, "nation"), [F.col("n_nationkey")], 99, 10).select("n_nationkey")


@register("top_brands", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_brands(spark, sf):
    return K.top_counts(table(spark, sf, "part"), "p_brand", 10)


@register("facet_options", "SELECT 'p_type' AS facet, p_type AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2")
def facet_options(spark, sf):
    p = table(spark, sf, "part")
    one = lambda c: p.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("facet"), "value", "n")
    return one("p_type").union(one("p_brand"))


@register("catalog_statistics", f"SELECT count(*) AS n, count(DISTINCT p_name) AS names, {P.format('avg(length(p_name))')} AS name_length, count(*) FILTER (p_size > 25) AS large FROM part")
def catalog_statistics(spark, sf):
    return table(spark, sf, "part").agg(F.count("*").alias("n"), F.countDistinct("p_name").alias("names"), q6(F.avg(F.length("p_name"))).alias("name_length"), F.count_if(F.col("p_size") > 25).alias("large"))


@register("keep_newest", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1 AS keep FROM orders")
def keep_newest(spark, sf):
    return K.keep_newest(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "keep")


@register(
    "upsert_latest",
    "WITH u AS (SELECT o_custkey, o_orderkey, o_orderdate, 0 AS w FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, 1 FROM orders WHERE o_orderkey % 3 = 0) SELECT o_custkey, o_orderdate FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, w DESC) = 1",
)
def upsert_latest(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return K.upsert(o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 3 = 0"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderdate")


@register("sync_difference", "SELECT coalesce(l.k, h.k) AS k, CASE WHEN h.k IS NULL THEN 'add' WHEN l.k IS NULL THEN 'delete' ELSE 'keep' END AS action FROM (SELECT DISTINCT o_custkey AS k FROM orders) l FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) h ON l.k = h.k")
def sync_difference(spark, sf):
    return K.sync_difference(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), "k")


@register(
    "two_level_lookup",
    "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(s.v, g.v) AS v FROM lineitem LEFT JOIN (SELECT s_suppkey AS l_suppkey, s_suppkey * 3 AS l_partkey, s_name AS v FROM supplier) s USING (l_suppkey, l_partkey) LEFT JOIN (SELECT p_partkey AS l_partkey, p_brand AS v FROM part WHERE p_size > 10) g USING (l_partkey)",
)
def two_level_lookup(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") * 3).alias("l_partkey"), F.col("s_name").alias("v"))
    g = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("v"))
    return K.two_level_lookup(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), s, g, ["l_suppkey", "l_partkey"], "v").drop("l_suppkey")


@register("not_known", "SELECT doc_id FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) AND lower(trim(text)) NOT IN (SELECT lower(trim(text)) FROM documents WHERE doc_id % 2 = 0)")
def not_known(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return K.not_known(d, d.where("doc_id % 2 = 0"), "doc_id", "text").select("doc_id")


@register(
    "canonical_map",
    "WITH RECURSIVE p AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha1(text)) AS root FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN doc_id - 1 END AS up FROM documents), r AS (SELECT doc_id, doc_id AS root, up FROM c UNION ALL SELECT r.doc_id, c.doc_id, c.up FROM r JOIN c ON c.doc_id = r.up) SELECT doc_id, root FROM r WHERE up IS NULL",
)
def canonical_map(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") - 1).alias("up"))
    return K.root_of_chain(d, "doc_id", "up")


@register("exact_duplicates", "SELECT sha1(text) AS digest, min(doc_id) AS canonical, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha1(F.col("text").cast("binary")).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("n"), F.countDistinct("source").alias("sources")).where("n > 1")


@register("association_pairs", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def association_pairs(spark, sf):
    return K.co_occurrence(table(spark, sf, "part"), "p_brand", "p_type", 20)


@register("class_profile", "SELECT p_type, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS names, count(DISTINCT p_name) AS n_tags FROM part GROUP BY 1")
def class_profile(spark, sf):
    return K.group_profile(table(spark, sf, "part"), "p_type", "p_brand", "p_name")


@register(
    "field_completeness",
    f"""WITH a AS (SELECT count(*) AS n, avg(CASE WHEN lang IS NOT NULL THEN 1.0 ELSE 0 END) AS l, avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0 END) AS q, count(*) FILTER (n_chars / 3000.0 >= 0.8) AS high, count(*) FILTER (n_chars / 3000.0 >= 0.6 AND n_chars / 3000.0 < 0.8) AS medium, count(*) FILTER (n_chars / 3000.0 < 0.6) AS low FROM documents LEFT JOIN labels USING (doc_id))
    SELECT n, {P.format("l")} AS lang_share, {P.format("q")} AS quality_share, high, medium, low, {P.format("l * 0.6 + q * 0.4")} AS score, CASE WHEN l * 0.6 + q * 0.4 >= 0.8 THEN 'good' WHEN l * 0.6 + q * 0.4 >= 0.6 THEN 'fair' ELSE 'poor' END AS level FROM a""",
)
def field_completeness(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    c = K.completeness(d, {"lang": 0.6, "quality": 0.4}, F.col("n_chars") / 3000.0)
    return c.select("n", *[q6(F.col(x)).alias(x) for x in ("lang_share", "quality_share")], "high", "medium", "low", q6(F.col("score")).alias("score"), "level")


@register("processing_progress", "SELECT count(*) AS total, count(*) FILTER (quality IS NOT NULL) AS processed, floor(count(quality) / count(*)::DOUBLE * 100)::BIGINT AS percent, min(doc_id) FILTER (quality IS NULL) AS oldest_pending, max(doc_id) AS newest FROM documents LEFT JOIN labels USING (doc_id)")
def processing_progress(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    done = F.col("quality").isNotNull()
    g = d.agg(F.count("*").alias("total"), F.count_if(done).alias("processed"), F.min(F.when(~done, F.col("doc_id"))).alias("oldest_pending"), F.max("doc_id").alias("newest"))
    return g.select("total", "processed", K.rate(F.col("processed"), F.col("total")).alias("percent"), "oldest_pending", "newest")


@register("remaining_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_rows(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@register("pooled_union", "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY 1")
def pooled_union(spark, sf):
    u = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).unionByName(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")))
    return u.groupBy("k").agg(F.count("*").alias("n"))


@register("recent_orders", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' - INTERVAL 48 HOUR AND o_orderdate <= TIMESTAMP '1999-01-01' AND o_orderstatus = 'O'")
def recent_orders(spark, sf):
    ref = F.to_timestamp(F.lit("1999-01-01 00:00:00"))
    o = table(spark, sf, "orders")
    return o.where((F.col("o_orderdate") >= ref - F.expr("INTERVAL 48 HOURS")) & (F.col("o_orderdate") <= ref) & (F.col("o_orderstatus") == "O")).select("o_orderkey")


@register("json_filter", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90")
def json_filter(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.where("k >= 90")


@register("duplicate_active", "SELECT p_name, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1 HAVING count(*) > 1")
def duplicate_active(spark, sf):
    return table(spark, sf, "part").where("p_size > 10").groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")


@register("cache_keys", "SELECT p_partkey, md5('{\"brand\":\"' || p_brand || '\",\"type\":\"' || p_type || '\"}') AS cache_key FROM part")
def cache_keys(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.md5(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")))).alias("cache_key"))
