"""Queries of field extraction and of the strict selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspring.operators import extraction as X
from marlspring.operators import selection as S
from marlspring.registry import register
from marlspring.session import table

#: Labels that the tables' texts hold, in four languages.
RULES = [
    X.Rule("origin", "label", ("from", "aus", "desde")),
    X.Rule("origin", "label", ("of the", "de la")),
    X.Rule("manner", "label", ("with", "avec", "mit"), True),
    X.Rule("manner", "label", ("for", "pour", "por"), True),
    X.Rule("function", "token", ("and", "und", "et", "y"), True),
    X.Rule("number", "shape", (r"(\d+)",)),
]
_VALUES = r"list_filter(list_transform(regexp_extract_all(text, '(?i)(?:{0})[\s:：]*([^\n]*)', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_ORIGIN = [_VALUES.format("from|aus|desde"), _VALUES.format("of the|de la")]
_MANNER = [_VALUES.format("with|avec|mit"), _VALUES.format("for|pour|por")]
_DISTINCT = "array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i), '; ')"


@register(
    "text_fields",
    f"""WITH v AS (SELECT doc_id, {_ORIGIN[0]} || {_ORIGIN[1]} AS o, {_MANNER[0]} || {_MANNER[1]} AS m, regexp_extract_all(text, '(?i)and|und|et|y') AS f, regexp_extract_all(text, '[0-9]+') AS n FROM documents)
    SELECT doc_id, 'origin' AS field, md5(o[1]) AS digest, length(o[1])::BIGINT AS n FROM v WHERE len(o) > 0
    UNION ALL SELECT doc_id, 'manner', md5({_DISTINCT.format("m")}), length({_DISTINCT.format("m")})::BIGINT FROM v WHERE len(m) > 0
    UNION ALL SELECT doc_id, 'function', md5({_DISTINCT.format("f")}), length({_DISTINCT.format("f")})::BIGINT FROM v WHERE len(f) > 0
    UNION ALL SELECT doc_id, 'number', md5(n[1]), length(n[1])::BIGINT FROM v WHERE len(n) > 0""",
)
def text_fields(spark, sf):
    f = X.fields(X.scan(table(spark, sf, "documents"), RULES))
    return f.select("doc_id", "field", F.md5("value").alias("digest"), F.length("value").cast("long").alias("n"))


@register(
    "field_matches",
    r"""WITH t AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'x': x})) AS l FROM documents)
    SELECT field, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(len)::BIGINT AS n_chars FROM (
      SELECT doc_id, 'number' AS field, length(unnest(regexp_extract_all(text, '[0-9]+'))) AS len FROM documents
      UNION ALL SELECT doc_id, 'function', length(unnest(regexp_extract_all(text, '(?i)and|und|et|y'))) FROM documents) GROUP BY 1""",
)
def field_matches(spark, sf):
    m = X.scan(table(spark, sf, "documents"), RULES[4:])
    return m.groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.col("stop") - F.col("start")).alias("n_chars"))


_CONTEXT = "'A stone of class ' || CASE o_custkey % 3 WHEN 0 THEN 'LL ' || (o_custkey % 7 + 1) WHEN 1 THEN 'cm' || (o_custkey % 7 + 1) ELSE 'none' END || ', found at ' || c_name || '. Origin: ' || lower(c_mktsegment)"


@register(
    "filled_fields",
    rf"""WITH a AS (SELECT o_orderkey, o_custkey, c_mktsegment, o_orderstatus, {_CONTEXT} AS t FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus WHEN o_custkey % 3 = 0 THEN 'LL' || (o_custkey % 7 + 1) WHEN o_custkey % 3 = 1 THEN 'CM' || (o_custkey % 7 + 1) ELSE 'Unknown' END AS classification,
      lower(c_mktsegment) AS origin, (1 + CASE WHEN o_orderstatus = 'O' AND o_custkey % 3 < 2 THEN 1 ELSE 0 END)::BIGINT AS filled FROM a""",
)
def filled_fields(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "Unknown").otherwise(F.col("o_orderstatus")).alias("classification"), F.lit(" ").alias("origin"), F.expr(_CONTEXT).alias("context"))
    return X.fill_missing(rows, "context").select("o_orderkey", "classification", "origin", "filled")


#: A standard for parts: names, brands and sizes stand for titles, tags and evidence.
PARTS = S.Standard(
    hard={"widget": "widget_boundary", "old": "age_boundary"}, soft={"blue": "colour_scope", "small": "size_scope", "red": "colour_scope"}, core=["ring", "bolt", "gear"],
    hints={f"Brand#{i}": f"brand {i} coverage" for i in range(1, 26, 2)}, hard_tags={"Brand#13": "brand_boundary"}, tag_terms={"Brand#7": ("brand_term", ["bolt"])}, reserve=["size_scope", S.WEAK],
)
_RISKS = """p AS (SELECT *, p_brand AS tag, p_size % 5 AS n, p_size % 4 = 0 AS named, p_size % 6 = 0 AS snip FROM part),
r AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN contains(p_name, 'widget') THEN 'widget_boundary' END, CASE WHEN contains(p_name, 'old') THEN 'age_boundary' END, CASE WHEN tag = 'Brand#13' THEN 'brand_boundary' END,
    CASE WHEN tag = 'Brand#7' AND contains(p_name, 'bolt') THEN 'brand_term' END, CASE WHEN n = 0 THEN 'missing_clear_organic_projection' END], lambda x: x IS NOT NULL))) AS hard,
  named OR contains(p_name, 'ring') OR contains(p_name, 'bolt') OR contains(p_name, 'gear') AS anchored FROM p),
s AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN contains(p_name, 'blue') OR contains(p_name, 'red') THEN 'colour_scope' END, CASE WHEN contains(p_name, 'small') THEN 'size_scope' END, CASE WHEN NOT anchored THEN 'weak_sample_anchor' END], lambda x: x IS NOT NULL))) AS soft FROM r),
l AS (SELECT *, CASE WHEN len(hard) = 0 AND len(soft) = 0 AND anchored AND n >= 2 THEN 'recommended_core_now' WHEN len(hard) = 0 AND anchored AND n >= 1 AND NOT list_has_any(soft, ['size_scope', 'weak_sample_anchor']) THEN 'backup_after_scope_check'
    WHEN len(hard) = 0 AND n >= 1 AND list_has_any(soft, ['size_scope', 'weak_sample_anchor']) THEN 'reserve_not_recommended_first' ELSE 'excluded' END AS likelihood FROM s),
g AS (SELECT *, substr(tag, 7)::INT % 2 = 1 AND coalesce(count(*) FILTER (likelihood <> 'excluded') OVER (PARTITION BY tag ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS gap FROM l),
a AS (SELECT *, (p_size % 10 + CASE WHEN named THEN 2 ELSE 0 END + CASE WHEN n >= 3 THEN 2 WHEN n >= 1 THEN 1 ELSE 0 END + CASE WHEN snip THEN 2 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN gap THEN 1 ELSE 0 END
    + CASE WHEN p_size % 8 = 0 THEN 3 ELSE 0 END + CASE p_type WHEN 'ECONOMY' THEN 3 WHEN 'SMALL' THEN 1 ELSE 0 END - CASE WHEN len(hard) > 0 THEN 100 ELSE 0 END - 10 * len(soft))::BIGINT AS score,
  CASE likelihood WHEN 'recommended_core_now' THEN 'low_scope_risk' WHEN 'backup_after_scope_check' THEN CASE WHEN len(soft) > 0 THEN 'medium_scope_risk' ELSE 'low_scope_risk' END WHEN 'reserve_not_recommended_first' THEN 'elevated_scope_risk'
    ELSE CASE WHEN len(hard) + len(soft) = 0 THEN 'excluded' ELSE array_to_string(list_sort(list_distinct(hard || soft)), '; ') END END AS scope_risk FROM g)"""


def _assessed(spark, sf):
    p = table(spark, sf, "part")
    flag = lambda c, text: F.when(c, text).otherwise("")
    rows = p.select(
        "p_partkey", F.col("p_name").alias("doc_name"), F.col("p_brand").alias("candidate_tags"), F.array_join(F.transform(F.slice(F.array(*[F.lit(f"c{i}") for i in range(5)]), F.lit(1), F.col("p_size") % 5), lambda x: x), "; ").alias("projected"),
        flag(F.col("p_size") % 4 == 0, "some name").alias("name"), flag(F.col("p_size") % 6 == 0, "text").alias("organic_snippet"), F.lit(None).cast("string").alias("name_snippet"), flag(F.col("p_size") % 7 == 0, "table_or_caption").alias("section_hints"),
        flag(F.col("p_size") % 8 == 0, "likely_core_gold").alias("recommendation"), F.when(F.col("p_type") == "ECONOMY", "high").when(F.col("p_type") == "SMALL", "medium").alias("review_priority"), (F.col("p_size") % 10).alias("priority_score"),
    )
    return S.assess(rows, ["p_partkey"], PARTS)


@register("strict_risk", f"WITH {_RISKS} SELECT p_partkey, likelihood, scope_risk, score, gap AS fills_gap FROM a")
def strict_risk(spark, sf):
    return _assessed(spark, sf).select("p_partkey", "likelihood", "scope_risk", "score", (F.size("gaps") > 0).alias("fills_gap"))


_RANKED = "ORDER BY score DESC, CASE likelihood WHEN 'recommended_core_now' THEN 3 WHEN 'backup_after_scope_check' THEN 2 ELSE 1 END DESC, CASE scope_risk WHEN 'low_scope_risk' THEN 3 WHEN 'medium_scope_risk' THEN 2 ELSE 1 END DESC, p_partkey"


@register("selected_core", f"WITH {_RISKS} SELECT p_partkey, score, likelihood FROM a WHERE likelihood <> 'excluded' {_RANKED} LIMIT 20")
def selected_core(spark, sf):
    return S.select_core(_assessed(spark, sf), 20, "p_partkey")[0].select("p_partkey", "score", "likelihood")


@register(
    "not_selected",
    f"""WITH {_RISKS}, b AS (SELECT p_partkey, p_name FROM a WHERE likelihood <> 'excluded' {_RANKED} LIMIT 20)
    SELECT p_partkey, CASE WHEN likelihood <> 'excluded' THEN 'reserve_overflow_after_limit' ELSE scope_risk END AS reason FROM a WHERE p_name NOT IN (SELECT p_name FROM b)""",
)
def not_selected(spark, sf):
    return S.select_core(_assessed(spark, sf), 20, "p_partkey")[1].select("p_partkey", "reason")
