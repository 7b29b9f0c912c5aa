"""Queries of the text operators over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspring.functions.scalars import q6
from marlspring.operators import text as T
from marlspring.registry import register
from marlspring.session import table

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
CHUNKS = rf"""chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, s AS start_char, content FROM
  (SELECT doc_id, s, {STRIP.format("substr(text, s + 1, 2800)")} AS content FROM
    (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 2800) / 2480.0))::INT)) * 2480 AS s FROM documents WHERE length(text) > 0)) WHERE content <> '')"""


def _chunks(spark, sf):
    return T.chunks(table(spark, sf, "documents"))


@register(
    "clean_text",
    r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\p{Cc}\p{Cf}\p{Co}\p{Cn}]', '', 'g'), 'x{0}', '') AS z,
      regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FEFF}\x{200B}-\x{200F}]', '', 'g') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(t, '([a-zA-Z])-\n([a-zA-Z])', '\1\2', 'g') AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM b)
    SELECT doc_id, md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS digest, length(regexp_replace(t, '^\s+|\s+$', '', 'g'))::BIGINT AS n FROM c""",
)
def clean_text(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@register("clean_flat", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def clean_flat(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"), False)).alias("digest"))


@register("token_count", "SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS n_tokens FROM documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@register("chunk_documents", f"WITH {CHUNKS} SELECT doc_id, chunk_index::BIGINT AS chunk_index, start_char::BIGINT AS start_char, md5(content) AS digest FROM chunks")
def chunk_documents(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_index", "start_char", F.md5("content").alias("digest"))


@register(
    "chunk_stats",
    rf"""WITH {CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, min(length(content)) AS min_chars, max(length(content)) AS max_chars,
      sum(length(content))::BIGINT AS sum_chars, sum(len(regexp_extract_all(content, '\S+')))::BIGINT AS sum_words,
      count(*) FILTER (length(content) < 500) AS small, count(*) FILTER (length(content) BETWEEN 500 AND 999) AS medium, count(*) FILTER (length(content) >= 1000) AS large FROM chunks""",
)
def chunk_stats(spark, sf):
    return T.chunk_statistics(_chunks(spark, sf))


@register("chunk_over_5", f"WITH {CHUNKS} SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 5")
def chunk_over_5(spark, sf):
    return _chunks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 5")


@register(
    "text_quality",
    r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    b AS (SELECT doc_id, t, length(t) AS n, len(string_split(t, chr(10))) AS lines, regexp_replace(t, '^\s+|\s+$', '', 'g') AS s,
      len(regexp_extract_all(t, '[^\x20-\x7E\n\t]')) AS np, len(regexp_extract_all(t, '\s{5,}')) > 10 AS sp, regexp_matches(t, '[.!?]{1,2}') AS pu,
      regexp_matches(t, '[\x00-\x08\x0b-\x1f\x7f-\x9f]') AS br, regexp_extract_all(t, '\S+') AS w FROM a),
    c AS (SELECT *, np / n::DOUBLE AS npr, coalesce(len(list_filter(w, lambda x: length(x) = 1)) / nullif(len(w), 0)::DOUBLE, 0) AS sr, n / greatest(lines, 1)::DOUBLE AS line FROM b),
    d AS (SELECT doc_id, CASE WHEN s = '' THEN 0.0 ELSE greatest(0.0, least(1.0, least(1.0, n / 1000::DOUBLE) * 0.2::DOUBLE + length(s) / n::DOUBLE * 0.15::DOUBLE + (1 - least(1.0, npr * 2)) * 0.25::DOUBLE
      + (0.5::DOUBLE + CASE WHEN pu THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN line > 20 AND line < 150 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN NOT sp THEN 0.1 ELSE 0 END::DOUBLE) * 0.25::DOUBLE
      - (CASE WHEN npr > 0.3 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN br THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN sr > 0.2 THEN 0.15 ELSE 0 END::DOUBLE))) END AS q, s,
      array_to_string(list_filter([CASE WHEN n < 100 THEN 'short' END, CASE WHEN sp THEN 'whitespace' END, CASE WHEN npr > 0.3 THEN 'gibberish' END, CASE WHEN br THEN 'encoding' END,
        CASE WHEN sr > 0.2 THEN 'single_characters' END, CASE WHEN NOT pu AND n > 500 THEN 'no_punctuation' END], lambda x: x IS NOT NULL), ',') AS w FROM c)
    SELECT doc_id, floor(q * 1000000 + 0.5)::BIGINT AS quality, CASE WHEN s = '' THEN 'empty' WHEN q >= 0.9 THEN 'excellent' WHEN q >= 0.7 THEN 'good' WHEN q >= 0.5 THEN 'fair' WHEN q >= 0.3 THEN 'poor' ELSE 'very_poor' END AS level,
      CASE WHEN s = '' THEN 'empty' ELSE w END AS warnings FROM d""",
)
def text_quality(spark, sf):
    return T.text_quality(table(spark, sf, "documents")).withColumn("quality", q6(F.col("quality")))


@register(
    "scanned_flag",
    f"""WITH {CHUNKS}, g AS (SELECT doc_id, count(*) AS p, count(*) FILTER (length(content) > 50) AS w, coalesce(sum(length(content)) FILTER (length(content) > 50), 0) AS c FROM chunks WHERE chunk_index < 3 GROUP BY 1),
    r AS (SELECT doc_id, w / p::DOUBLE AS r, c / p::DOUBLE AS a FROM g)
    SELECT doc_id, floor(r * 1000000 + 0.5)::BIGINT AS text_ratio, floor(a * 1000000 + 0.5)::BIGINT AS avg_chars, r < 0.2 OR a < 100 AS is_scanned,
      floor(CASE WHEN r = 0 THEN 0.95 WHEN r < 0.1 THEN 0.85 WHEN r < 0.2 THEN 0.7 WHEN a < 100 THEN 0.6 ELSE 0.3 END * 1000000 + 0.5)::BIGINT AS confidence FROM r""",
)
def scanned_flag(spark, sf):
    f = T.scanned_flag(_chunks(spark, sf))
    return f.select("doc_id", q6(F.col("text_ratio")).alias("text_ratio"), q6(F.col("avg_chars")).alias("avg_chars"), "is_scanned", q6(F.col("confidence")).alias("confidence"))


NOISE = r"""a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
  b AS (SELECT doc_id, t, length(t) AS chars, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM a),
  c AS (SELECT doc_id, chars::BIGINT AS chars, len(l)::BIGINT AS lines, len(list_filter(l, lambda x: length(x) <= 3))::BIGINT AS short_lines, len(regexp_extract_all(t, '[A-Za-z0-9]+'))::BIGINT AS n_tokens,
    len(regexp_extract_all(t, '\p{L}'))::BIGINT AS alpha, len(regexp_extract_all(t, '[^\x00-\x7F]'))::BIGINT AS non_ascii, len(regexp_extract_all(t, chr(65533)))::BIGINT AS replacements,
    len(regexp_extract_all(t, '[ÃÂâ€]'))::BIGINT AS mojibake FROM b),
  n AS (SELECT *, (least(1.0, replacements / 20.0) + least(1.0, mojibake / 50.0) + least(1.0, coalesce(short_lines / nullif(lines, 0)::DOUBLE, 0)) + CASE WHEN chars > 0 THEN 1 - least(1.0, alpha / chars::DOUBLE / 0.65) ELSE 1 END) / 4.0 AS noise FROM c),
  k AS (SELECT *, CASE WHEN chars < 100 THEN 'very_low_text' WHEN chars < 1000 THEN 'low_text' WHEN noise > 0.35 THEN 'noisy' ELSE 'machine_readable' END AS quality_class FROM n)"""


@register("noise_metrics", f"WITH {NOISE} SELECT * EXCLUDE (noise), floor(noise * 1000000 + 0.5)::BIGINT AS noise FROM k")
def noise_metrics(spark, sf):
    return T.noise_metrics(table(spark, sf, "documents")).drop("single_tokens").withColumn("noise", q6(F.col("noise")))


QUOTAS = {"very_low_text": 4, "low_text": 5, "noisy": 3, "machine_readable": 4}


@register(
    "stratified_sample",
    f"""WITH {NOISE}, s AS (SELECT doc_id, quality_class, row_number() OVER (PARTITION BY quality_class ORDER BY doc_id) <= CASE quality_class WHEN 'very_low_text' THEN 4 WHEN 'low_text' THEN 5 WHEN 'noisy' THEN 3 ELSE 4 END AS own FROM k)
    SELECT doc_id, quality_class, CASE WHEN own THEN 'quota' ELSE 'fill' END AS pick FROM s ORDER BY own DESC, doc_id LIMIT 18""",
)
def stratified_sample(spark, sf):
    return T.stratified_sample(T.noise_metrics(table(spark, sf, "documents")), QUOTAS, 18)


@register(
    "structure_audit",
    r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    b AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM a)
    SELECT doc_id, len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '\b(Table|TABLE)\s+(S?\d+|[IVX]+)\b'))::BIGINT AS table_marks, len(regexp_extract_all(t, '\b(Fig|Figure|FIG|FIGURE)\b'))::BIGINT AS figure_marks,
      len(list_filter(l, lambda x: regexp_matches(x, '(?i)^(Table|Fig\.?|Figure)\s*(S?\d+|[IVX]+)?[.:]?\s+.{20,}')))::BIGINT AS captions,
      len(list_filter(l, lambda x: len(regexp_extract_all(x, '\d+(\.\d+)?')) >= 3 AND regexp_matches(x, '\||\t|(?i)\b(ppm|ppb)\b')))::BIGINT AS row_lines,
      len(list_filter(l, lambda x: regexp_matches(x, '(?i)\b(shown in|see|listed in|summarized in|presented in) (Table|Fig|Figure)\b')))::BIGINT AS "references" FROM b""",
)
def structure_audit(spark, sf):
    return T.structure_audit(table(spark, sf, "documents"))


@register(
    "text_complexity",
    r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    b AS (SELECT doc_id, length(t)::BIGINT AS chars, len(regexp_extract_all(t, '\S+'))::BIGINT AS n_words, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S')))::BIGINT AS n_lines,
      len(list_filter(string_split(t, chr(10) || chr(10)), lambda x: regexp_matches(x, '\S')))::BIGINT AS n_paragraphs, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: regexp_matches(x, '\S')))::BIGINT AS n_sentences FROM a)
    SELECT *, floor(least(1.0, coalesce(chars / nullif(n_words, 0)::DOUBLE, 0) / 10.0) * 1000000 + 0.5)::BIGINT AS score FROM b""",
)
def text_complexity(spark, sf):
    return T.complexity(table(spark, sf, "documents")).withColumn("score", q6(F.col("score")))


@register(
    "doi_year_title",
    r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, nullif(regexp_extract(t, '(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)', 1), '') AS doi,
      list_max(list_filter(list_transform(regexp_extract_all(substr(t, 1, 3000), '\b((?:18|19|20)\d\d)\b', 1), lambda y: y::BIGINT), lambda y: y <= 2026)) AS year,
      list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) BETWEEN 10 AND 200)[1] AS title FROM a""",
)
def doi_year_title(spark, sf):
    return T.academic_metadata(table(spark, sf, "documents"), 2026)


@register(
    "clean_titles",
    r"""WITH a AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(raw, '\s+', ' ', 'g'), '^[\s.,;:_-]+|[\s,;:_-]+$', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM a)
    SELECT page_id, CASE WHEN lower(t) NOT IN ('', 'unknown', 'untitled', 'none', 'null', 'n/a') THEN left(t, 200) END AS title,
      regexp_matches(t, '^10\.\d{4,9}/') OR regexp_matches(t, '^[0-9a-fA-F]{16,}$') OR regexp_matches(t, '^[A-Z]{2,6}[-_ ]?\d{3,}$') OR coalesce(length(regexp_replace(t, '[^0-9]', '', 'g')) / nullif(length(t), 0)::DOUBLE, 0) > 0.5 AS is_id FROM b""",
)
def clean_titles(spark, sf):
    t = table(spark, sf, "pages").select("page_id", T.clean_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    return t.select("page_id", "title", F.coalesce(T.is_document_id(F.col("title")), F.lit(False)).alias("is_id"))


@register(
    "snippets",
    r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 240 THEN left(t, 237) || '...' ELSE t END AS snippet, left(sha1(source || sha1(d.text)), 16) AS doc_key, left(sha256(d.text), 12) AS question FROM a JOIN documents d USING (doc_id)""",
)
def snippets(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.document_key(F.col("source"), F.col("text")).alias("doc_key"), T.question_hash(F.col("text")).alias("question"))


@register(
    "highlight",
    """SELECT doc_id, left(text, p - 1) AS before, substr(text, p, 7) AS match, md5(substr(text, p + 7)) AS after FROM (SELECT *, instr(lower(text), 'license') AS p FROM documents) WHERE p > 0""",
)
def highlight(spark, sf):
    return T.highlight(table(spark, sf, "documents"), "text", "license").select("doc_id", "before", "match", F.md5("after").alias("after"))


@register(
    "best_chunk",
    rf"""WITH {CHUNKS}, s AS (SELECT doc_id, chunk_index, floor(((len(regexp_extract_all(lower(content), '\bthe\b')) + len(regexp_extract_all(lower(content), '\bof\b'))) * 1000.0::DOUBLE / greatest(length(content), 1)
      + least(1.0, length(content) / 2000.0::DOUBLE)) * 1000000 + 0.5)::BIGINT AS score FROM chunks)
    SELECT doc_id, chunk_index::BIGINT AS chunk_index, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_index) = 1""",
)
def best_chunk(spark, sf):
    return T.best_chunk(_chunks(spark, sf), ["the", "of"])


@register(
    "domain_relevant",
    r"SELECT doc_id FROM documents WHERE length(text) >= 50 AND regexp_matches(lower(text), '\b(license|token|theher)\b') AND NOT regexp_matches(lower(text), '\b(password|secret)\b')",
)
def domain_relevant(spark, sf):
    return table(spark, sf, "documents").where(T.domain_relevant(F.col("text"), ["license", "token", "theher"], ["password", "secret"])).select("doc_id")


@register(
    "clean_segments",
    rf"""WITH {CHUNKS}, l AS (SELECT doc_id, chunk_index, content, string_split(content, chr(10)) AS l FROM chunks),
    k AS (SELECT doc_id, chunk_index, content, array_to_string(list_filter(l, lambda x, i: i > 10 OR NOT regexp_matches(x, '(?i)^\s*(page \d+|\d+|doi:.*|https?://\S+|copyright.*|©.*)\s*$')), chr(10)) AS kept FROM l)
    SELECT doc_id, chunk_index::BIGINT AS chunk_index, md5(CASE WHEN length(kept) < 0.3 * length(content) THEN content ELSE kept END) AS digest FROM k""",
)
def clean_segments(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_index", F.md5(T.clean_segment(F.col("content"))).alias("digest"))


@register("reference_section", None)
def reference_section(spark, sf):
    return T.drop_references(_chunks(spark, sf)).select("doc_id", "chunk_index")


@register("json_recovery", "SELECT event_id, props AS part FROM events WHERE json_valid(props)")
def json_recovery(spark, sf):
    e = table(spark, sf, "events").select("event_id", T.json_part(F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n``` done"))).alias("part"))
    return e.where("part IS NOT NULL")
