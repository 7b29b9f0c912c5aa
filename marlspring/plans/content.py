"""Queries of content recommendation, nested values, recovered answers and paper metadata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlspring.operators import academic as A
from marlspring.operators import content as C
from marlspring.operators import nested as J
from marlspring.registry import register
from marlspring.session import table

#: All users against all items; a preference is a feature's share of the user's most frequent one.
_LIKES = """b AS (SELECT o_custkey AS u, l_partkey AS item, p_brand, p_type FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
f AS (SELECT u, feature, count(*) AS n FROM (SELECT u, p_brand AS feature FROM b UNION ALL SELECT u, p_type FROM b) GROUP BY 1, 2),
likes AS (SELECT u, feature, n / (max(n) OVER (PARTITION BY u))::DOUBLE AS w FROM f),
has AS (SELECT p_partkey AS item, p_brand AS feature, 1.0::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, p_type, 0.25 + p_size / 100.0::DOUBLE FROM part),
m AS (SELECT u, item, sum(w * v * abs(w)) / sum(abs(w)) AS s FROM likes JOIN has USING (feature) GROUP BY 1, 2 HAVING sum(w * v * abs(w)) / sum(abs(w)) > 0.3),
fresh AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.u = m.u AND b.item = m.item))"""


def _bought(spark, sf):
    o, i = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user")), table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"))
    return o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).select("user", "item")


def _kinds(spark, sf):
    """Preferences from what was bought, which lies by user once and is counted there, against all parts."""
    b, p = _bought(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_type", "p_size")
    likes = b.join(p, "item").select("user", "p_brand", "p_type").repartition("user")
    n = likes.select("user", F.explode(F.array("p_brand", "p_type")).alias("feature")).groupBy("user", "feature").agg(F.count("*").alias("n"))
    likes = n.select("user", "feature", (F.col("n") / F.max("n").over(Window.partitionBy("user"))).alias("weight"))
    of = lambda feature, value: F.struct(F.col(feature).alias("feature"), value.alias("value"))
    has = p.select("item", F.inline(F.array(of("p_brand", F.lit(1.0)), of("p_type", 0.25 + F.col("p_size") / 100.0))))
    return C.Kinds(likes, has, b)


@register(
    "content_recommended",
    f"""WITH {_LIKES}, q AS (SELECT u, item, floor(s * 1000000 + 0.5)::BIGINT AS similarity, count(*) OVER (PARTITION BY u) AS n FROM fresh)
    SELECT u AS "user", item, similarity, row_number() OVER (PARTITION BY u ORDER BY similarity DESC, item) AS rank, n FROM q QUALIFY rank <= 10""",
)
def content_recommended(spark, sf):
    return C.best_of_kinds(_kinds(spark, sf))


@register("content_matches", f'WITH {_LIKES} SELECT u AS "user", count(*) AS n, sum(item)::BIGINT AS items FROM fresh GROUP BY 1')
def content_matches(spark, sf):
    return C.match_counts(_kinds(spark, sf))


#: A nested value for each order, written alike in both dialects; strings hold braces, quotes and backslashes.
_NESTED = """'{"order": {"key":' || cast(o_orderkey AS varchar(20)) || ', "status":"' || o_orderstatus || '", "tags":[' ||
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '"' || o_orderpriority || '"' WHEN 2 THEN '"a{b", "c' || chr(92) || '"]d", [1, {"x":null}]' ELSE '[[' || cast(o_custkey AS varchar(20)) || '], {}]' END ||
  ']}, "who":' || CASE o_custkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '{"id":' || cast(o_custkey AS varchar(20)) || ', "name":"Customer No ' || cast(o_custkey AS varchar(20)) || '"}' ELSE '"back' || chr(92) || chr(92) || '"' END || '}'"""


def _orders_json(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(_NESTED).alias("j"))


_TREE = f"WITH a AS (SELECT o_orderkey, {_NESTED} AS j FROM orders), t AS (SELECT a.o_orderkey, x.* FROM a, json_tree(a.j) AS x)"
_STEPS = r"len(regexp_extract_all(replace(fullkey, '$', ''), '\.|\['))"


@register(
    "object_measures",
    f"""{_TREE} SELECT o_orderkey, max(CASE WHEN type IN ('OBJECT', 'ARRAY') THEN {_STEPS} + 1 ELSE 0 END)::BIGINT AS depth, (count(*) - 1)::BIGINT AS fields,
      bool_or(type IN ('OBJECT', 'ARRAY') AND {_STEPS} = 1) AS nested FROM t GROUP BY 1""",
)
def object_measures(spark, sf):
    return J.object_measures(_orders_json(spark, sf), "o_orderkey", "j").drop("size")


@register(
    "object_keywords",
    rf"""{_TREE}, w AS (SELECT o_orderkey, regexp_replace(regexp_replace(substr(fullkey, 3), '\[([0-9]+)\]', '.\1', 'g'), '^\.', '') AS word FROM t WHERE fullkey <> '$'
      UNION ALL SELECT o_orderkey, lower(json_extract_string(value, '$')) FROM t WHERE type = 'VARCHAR' AND length(json_extract_string(value, '$')) > 2)
    SELECT o_orderkey, count(DISTINCT word) AS n, md5(array_to_string(list_sort(list(DISTINCT word)), '|')) AS digest FROM w GROUP BY 1""",
)
def object_keywords(spark, sf):
    k = _orders_json(spark, sf).select("o_orderkey", J.keywords(F.col("j")).alias("k"))
    return k.select("o_orderkey", F.size("k").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("k"), "|")).alias("digest"))


#: Answers with text around the value; some are cut before their last closing braces.
_ANSWER = f"""CASE o_orderkey % 5 WHEN 0 THEN 'So: ' || {_NESTED} || ' and {{more}} of it' WHEN 1 THEN '```json' || chr(10) || {_NESTED} || chr(10) || '``` done {{' WHEN 2 THEN 'x' || chr(7) || {_NESTED}
  WHEN 3 THEN left({_NESTED}, length({_NESTED}) - 1) ELSE 'no value here' END"""


@register("balanced_answers", f"SELECT o_orderkey, md5({_NESTED}) AS digest FROM orders WHERE o_orderkey % 5 < 4")
def balanced_answers(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", F.expr(_ANSWER).alias("t"))
    return a.select("o_orderkey", F.md5(J.balanced_json(F.col("t"))).alias("digest")).where("digest IS NOT NULL")


#: The first page of a paper for each part: parts of it are missing where the key says so.
_ABSTRACT = "'We report the abundance of ' || p_name || ' (' || p_brand || ') in a set of ' || cast(p_size AS varchar(9)) || ' stones, and what it says of their origin.'"
_PAPER = f"""CASE WHEN p_partkey % 2 = 0 THEN '10.' || cast(100000 + p_partkey AS varchar(9)) || '/meteorstudies-' || cast(p_partkey AS varchar(9)) || chr(10) ELSE '' END || '0004-637X 783 2 140' || chr(10) ||
  'On the Distribution of ' || p_name || chr(10) || '  among stones of size ' || cast(p_size AS varchar(9)) || ' around the early Sun ' || chr(10) || 'Anna Smith, Peter Jones' || chr(10) || 'Received 3 May ' || cast(1990 + p_partkey % 30 AS varchar(9)) || chr(10) || 'Accepted 4 June' || chr(10) || 'Editors: some' || chr(10) ||
  CASE WHEN p_partkey % 3 = 0 THEN 'Abstract' || chr(10) || {_ABSTRACT} || chr(10) || chr(10) ELSE 'Abstract short' || chr(10) || chr(10) END ||
  CASE WHEN p_partkey % 5 > 0 THEN 'Keywords: ' || p_name || ', ' || p_type || chr(10) ELSE '' END || 'Introduction' || chr(10) || CASE WHEN p_partkey % 7 < 3 THEN 'as shown in Icarus before.' ELSE 'As shown, by Stellar Physics 42 (2011) before.' END"""


@register(
    "paper_metadata",
    f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '10.' || (100000 + p_partkey) || '/meteorstudies-' || p_partkey END AS doi, (CASE WHEN p_partkey % 7 < 3 THEN 1990 + p_partkey % 30 ELSE greatest(2011, 1990 + p_partkey % 30) END)::BIGINT AS year,
      CASE WHEN p_partkey % 2 = 0 THEN 'meteorstudies' WHEN p_partkey % 7 < 3 THEN 'Icarus' ELSE 'by Stellar Physics' END AS journal, 'Anna Smith, Peter Jones' AS authors,
      'On the Distribution of ' || p_name || ' among stones of size ' || p_size || ' around the early Sun Anna Smith, Peter Jones' AS title,
      CASE WHEN p_partkey % 3 = 0 THEN {_ABSTRACT} END AS abstract, CASE WHEN p_partkey % 5 > 0 THEN p_name || ', ' || p_type END AS keywords FROM part""",
)
def paper_metadata(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr(_PAPER).alias("text"))
    return A.paper_metadata(p, 2026, "p_partkey")
