"""Queries of chunk kinds, special evidence and classes named outright."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlspring.operators import evidence as E
from marlspring.operators.text import chunks
from marlspring.plans.text import CHUNKS
from marlspring.registry import register
from marlspring.session import table

#: Words of the tables' texts that stand for classes.
NAMED = [(r"(?i)\b(mention|mentions)\b", "mention"), (r"\b[0-9]{8,}\b", "number"), (r"(?i)\b(license|licence)\b", "license"), (r"the of", "of"), (r"que la", "que")]
_NAMED = "list_distinct(list_filter([CASE WHEN regexp_matches({0}, '(?i)\\b(mention|mentions)\\b') THEN 'mention' END, CASE WHEN regexp_matches({0}, '\\b[0-9]{{8,}}\\b') THEN 'number' END, CASE WHEN regexp_matches({0}, '(?i)\\b(license|licence)\\b') THEN 'license' END, CASE WHEN regexp_matches({0}, 'the of') THEN 'of' END, CASE WHEN regexp_matches({0}, 'que la') THEN 'que' END], lambda x: x IS NOT NULL))"
_YEARS = r"len(regexp_extract_all(lower(content), '\b(?:19|20)[0-9]{2}\b'))"


@register(
    "chunk_kinds",
    rf"""WITH {CHUNKS} SELECT doc_id, chunk_index::BIGINT AS chunk_index, contains(lower(content), 'references') OR len(regexp_extract_all(lower(content), ' et al')) >= 2 OR (contains(lower(content), 'doi') AND {_YEARS} >= 2) OR {_YEARS} >= 5 AS is_reference,
      regexp_matches(lower(content), 'table |tables |table 1|table 2|fig\.|figure |caption') AS is_table, regexp_matches(lower(content), 'article history|received |accepted |available online|department of|university|corresponding author|keywords:|email:') AS is_front FROM chunks""",
)
def chunk_kinds(spark, sf):
    c = F.col("content")
    return chunks(table(spark, sf, "documents")).select("doc_id", "chunk_index", E.reference_like(c).alias("is_reference"), E.holds(c, E.TABLE_OR_CAPTION).alias("is_table"), E.holds(c, E.FRONT_MATTER).alias("is_front"))


_SCORED = rf"""{CHUNKS}, s AS (SELECT doc_id, chunk_index, content, row_number() OVER (PARTITION BY doc_id ORDER BY length(content) - length(replace(content, 'an', '')) DESC, chunk_index) AS rank FROM chunks),
p AS (SELECT *, CASE WHEN rank <= 2 THEN rank END AS place, regexp_matches(content, '[0-9]{{3}}') AS sp, contains(content, 'zz') AS ref FROM s),
w AS (SELECT *, coalesce(bool_or(place IS NOT NULL AND sp) OVER (PARTITION BY doc_id), false) AS settled, max(place) OVER (PARTITION BY doc_id) AS n, min(CASE WHEN place IS NULL AND sp AND NOT ref THEN rank END) OVER (PARTITION BY doc_id) AS first FROM p)"""


def _scored(spark, sf):
    c = chunks(table(spark, sf, "documents"))
    an = F.length("content") - F.length(F.replace("content", F.lit("an"), F.lit("")))
    rows = c.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(an.desc(), "chunk_index")))
    return rows.withColumn("place", F.when(F.col("rank") <= 2, F.col("rank")).cast("long"))


def _picked(spark, sf):
    return E.with_special(_scored(spark, sf), "doc_id", "chunk_index", 2, F.col("content").rlike("[0-9]{3}"), F.col("content").contains("zz"))


@register(
    "special_evidence",
    f"""WITH {_SCORED} SELECT doc_id, chunk_index::BIGINT AS chunk_index, CASE WHEN place IS NULL THEN least(n + 1, 2) ELSE place END AS place, place IS NULL AS swapped FROM w
    WHERE (place IS NOT NULL AND NOT (NOT settled AND first IS NOT NULL AND n >= 2 AND place = 2)) OR (NOT settled AND place IS NULL AND rank = first)""",
)
def special_evidence(spark, sf):
    return _picked(spark, sf).select("doc_id", "chunk_index", "place", "swapped")


@register(
    "named_classes",
    f"""WITH {_SCORED}, k AS (SELECT doc_id, content, CASE WHEN place IS NULL THEN least(n + 1, 2) ELSE place END AS place FROM w
      WHERE (place IS NOT NULL AND NOT (NOT settled AND first IS NOT NULL AND n >= 2 AND place = 2)) OR (NOT settled AND place IS NULL AND rank = first)),
    e AS (SELECT doc_id, unnest({_NAMED.format("content")}) AS name FROM k WHERE NOT (contains(lower(content), 'references') OR len(regexp_extract_all(lower(content), ' et al')) >= 2 OR (contains(lower(content), 'doi') AND {_YEARS} >= 2) OR {_YEARS} >= 5)),
    a AS (SELECT doc_id, lang AS name FROM documents WHERE coalesce(trim(lang), '') <> '' UNION SELECT doc_id, name FROM e)
    SELECT doc_id, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), '; '), '') AS names FROM documents LEFT JOIN a USING (doc_id) GROUP BY 1""",
)
def named_classes(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.lit(None).cast("string").alias("title"))
    found = E.augmented(rows, _picked(spark, sf), "doc_id", "lang", "title", NAMED)
    return found.select("doc_id", F.array_join(F.array_sort(F.split("tokens", "; ")), "; ").alias("names"))
