"""Cleaning, chunking, quality and audits of document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspring.functions.scalars import clamp, count_matches, share, strip, words

#: Characters of a token, tokens of a chunk and of its overlap.
CHARS_PER_TOKEN, CHUNK_TOKENS, OVERLAP_TOKENS = 4, 700, 80


def clean_text(c: Column, keep_structure: bool = True) -> Column:
    """Control characters out, line ends unified, broken words joined, white space collapsed, ends stripped."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\P{C}\n\t\r]", "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    if keep_structure:
        t = F.regexp_replace(t, r"([a-zA-Z])-\n([a-zA-Z])", "$1$2")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n") if keep_structure else F.regexp_replace(t, r"\s+", " ")
    return strip(t)


def token_count(c: Column) -> Column:
    """Approximate tokens: a quarter of the characters, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(c, F.lit(""))) / CHARS_PER_TOKEN)).cast("long")


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_tokens: int = CHUNK_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """key, chunk_index (dense), start_char, content of overlapping windows; empty windows are left out.

    A row's own windows are exploded and numbered inside the row, so there is no shuffle.
    """
    size, step = chunk_tokens * CHARS_PER_TOKEN, max(1, (chunk_tokens - overlap_tokens) * CHARS_PER_TOKEN)
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    cut = F.filter(F.transform(starts, lambda s: F.struct(s.alias("start_char"), strip(F.substring(F.col(text), s + 1, F.lit(size))).alias("content"))), lambda x: x["content"] != "")
    return docs.select(F.col(key), F.posexplode(cut).alias("chunk_index", "x")).select(key, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("x.start_char").cast("long").alias("start_char"), "x.content")


def chunk_statistics(chunked: DataFrame) -> DataFrame:
    """One row: counts, lengths in characters and words, and size buckets."""
    n, w = F.length("content"), F.size(words(F.col("content")))
    return chunked.agg(
        F.count("*").alias("n_chunks"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.min(n).cast("long").alias("min_chars"),
        F.max(n).cast("long").alias("max_chars"),
        F.sum(n).alias("sum_chars"),
        F.sum(w).alias("sum_words"),
        F.count_if(n < 500).alias("small"),
        F.count_if((n >= 500) & (n < 1000)).alias("medium"),
        F.count_if(n >= 1000).alias("large"),
    )


def text_quality(docs: DataFrame) -> DataFrame:
    """doc_id, quality (0..1), level and warnings of each text."""
    t, n = F.col("text"), F.length("text")
    lines = F.size(F.split(t, "\n"))
    non_printable = share(count_matches(t, r"[^\x20-\x7E\n\t]"), n)
    ws = words(t)
    single = share(F.size(F.filter(ws, lambda w: F.length(w) == 1)), F.size(ws))
    spaces, punctuated, line = count_matches(t, r"\s{5,}") > 10, t.rlike(r"[.!?]{1,2}"), n / F.greatest(lines, F.lit(1))
    broken = t.rlike(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")
    structure = 0.5 + F.when(punctuated, 0.2).otherwise(0.0) + F.when((line > 20) & (line < 150), 0.2).otherwise(0.0) + F.when(~spaces, 0.1).otherwise(0.0)
    penalty = F.when(non_printable > 0.3, 0.3).otherwise(0.0) + F.when(broken, 0.2).otherwise(0.0) + F.when(single > 0.2, 0.15).otherwise(0.0)
    score = clamp(F.least(F.lit(1.0), n / 1000) * 0.2 + share(F.length(strip(t)), n) * 0.15 + (1.0 - F.least(F.lit(1.0), non_printable * 2)) * 0.25 + structure * 0.25 - penalty)
    told = F.array_compact(
        F.array(
            F.when(n < 100, "short"),
            F.when(spaces, "whitespace"),
            F.when(non_printable > 0.3, "gibberish"),
            F.when(broken, "encoding"),
            F.when(single > 0.2, "single_characters"),
            F.when(~punctuated & (n > 500), "no_punctuation"),
        )
    )
    empty = F.col("blank")
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blank", strip(F.col("text")) == "")
    q = F.when(empty, 0.0).otherwise(score)
    return df.select("doc_id", q.alias("quality"), F.when(empty, "empty").when(q >= 0.9, "excellent").when(q >= 0.7, "good").when(q >= 0.5, "fair").when(q >= 0.3, "poor").otherwise("very_poor").alias("level"), F.array_join(F.when(empty, F.array(F.lit("empty"))).otherwise(told), ",").alias("warnings"))


def scanned_flag(pages: DataFrame, sample: int = 3) -> DataFrame:
    """doc_id, text_ratio, avg_chars, is_scanned, confidence from the first pages of each document (doc_id, chunk_index, content)."""
    n = F.length(strip(F.col("content")))
    g = pages.where(F.col("chunk_index") < sample).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(n > 50).alias("with_text"), F.sum(F.when(n > 50, n).otherwise(0)).alias("chars"))
    ratio, avg = F.col("with_text") / F.col("pages"), F.col("chars") / F.col("pages")
    conf = F.when(ratio == 0, 0.95).when(ratio < 0.1, 0.85).when(ratio < 0.2, 0.7).when(avg < 100, 0.6).otherwise(0.3)
    return g.select("doc_id", ratio.alias("text_ratio"), avg.alias("avg_chars"), ((ratio < 0.2) | (avg < 100)).alias("is_scanned"), conf.alias("confidence"))


def noise_metrics(docs: DataFrame) -> DataFrame:
    """doc_id and the robustness measures of a text, with its noise score and class."""
    t = F.col("t")
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")
    df = docs.select("doc_id", strip(F.coalesce("text", F.lit(""))).alias("t")).select("*", F.length("t").cast("long").alias("chars"), F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: F.length(x) <= 3)).cast("long").alias("short_lines"))
    df = df.select(
        "doc_id", "chars", "lines", "short_lines",
        count_matches(t, "[A-Za-z0-9]+").alias("n_tokens"),
        count_matches(t, r"\p{L}").alias("alpha"),
        count_matches(t, r"[^\x00-\x7F]").alias("non_ascii"),
        count_matches(t, "�").alias("replacements"),
        count_matches(t, "[ÃÂâ€]").alias("mojibake"),
        count_matches(t, r"\b[A-Za-z]\b").alias("single_tokens"),
    )
    some = F.col("chars") > 0
    noise = (F.least(F.lit(1.0), F.col("replacements") / 20.0) + F.least(F.lit(1.0), F.col("mojibake") / 50.0) + F.least(F.lit(1.0), share(F.col("short_lines"), F.col("lines"))) + F.when(some, 1.0 - F.least(F.lit(1.0), share(F.col("alpha"), F.col("chars")) / 0.65)).otherwise(1.0)) / 4.0
    return df.withColumn("noise", noise).withColumn("quality_class", F.when(F.col("chars") < 100, "very_low_text").when(F.col("chars") < 1000, "low_text").when(F.col("noise") > 0.35, "noisy").otherwise("machine_readable"))


def stratified_sample(classed: DataFrame, quotas: dict[str, int], n: int, key: str = "doc_id") -> DataFrame:
    """key, quality_class, pick of n rows: each class's first rows up to its quota, then the rest in order."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    k = F.row_number().over(Window.partitionBy("quality_class").orderBy(key))
    first = classed.select(key, "quality_class").withColumn("k", k).withColumn("own", F.col("k") <= F.coalesce(quota[F.col("quality_class")], F.lit(0)))
    # n rows of the order, by a bounded top-n and not by one global window.
    top = first.orderBy(F.desc("own"), key).limit(n)
    return top.select(key, "quality_class", F.when(F.col("own"), "quota").otherwise("fill").alias("pick"))


def structure_audit(docs: DataFrame) -> DataFrame:
    """doc_id and counts of table and figure marks, captions, row-like lines, and references to them."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lines.alias("l"))
    caption = r"(?i)^(Table|Fig\.?|Figure)\s*(S?\d+|[IVX]+)?[.:]?\s+.{20,}"
    return df.select(
        "doc_id",
        F.size("l").cast("long").alias("n_lines"),
        count_matches(F.col("text"), r"\b(Table|TABLE)\s+(S?\d+|[IVX]+)\b").alias("table_marks"),
        count_matches(F.col("text"), r"\b(Fig|Figure|FIG|FIGURE)\b").alias("figure_marks"),
        F.size(F.filter("l", lambda x: x.rlike(caption))).cast("long").alias("captions"),
        F.size(F.filter("l", lambda x: (F.regexp_count(x, F.lit(r"\d+(\.\d+)?")) >= 3) & x.rlike(r"\||\t|(?i)\b(ppm|ppb)\b"))).cast("long").alias("row_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"(?i)\b(shown in|see|listed in|summarized in|presented in) (Table|Fig|Figure)\b"))).cast("long").alias("references"),
    )


def complexity(docs: DataFrame) -> DataFrame:
    """doc_id, characters, words, lines, paragraphs, sentences, and a score from 0 to 1."""
    t = F.coalesce("text", F.lit(""))
    some = lambda pattern: F.size(F.filter(F.split(t, pattern), lambda x: strip(x) != "")).cast("long")
    df = docs.select("doc_id", F.length(t).cast("long").alias("chars"), F.size(words(t)).cast("long").alias("n_words"), some("\n").alias("n_lines"), some("\n\n").alias("n_paragraphs"), some("[.!?]+").alias("n_sentences"))
    return df.withColumn("score", F.least(F.lit(1.0), share(F.col("chars"), F.col("n_words")) / 10.0))


def academic_metadata(docs: DataFrame, this_year: int) -> DataFrame:
    """doc_id, doi, year (the latest from 1800 on in the first 3000 characters), and the first line as a title."""
    t = F.coalesce("text", F.lit(""))
    years = F.filter(F.transform(F.regexp_extract_all(F.substring(t, 1, 3000), F.lit(r"\b((?:18|19|20)\d\d)\b"), F.lit(1)), lambda y: y.cast("int")), lambda y: y <= this_year)
    doi = F.regexp_extract(t, r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)", 1)
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: (F.length(x) >= 10) & (F.length(x) <= 200))
    return docs.select("doc_id", F.when(doi != "", doi).alias("doi"), F.array_max(years).cast("long").alias("year"), F.get(lines, F.lit(0)).alias("title"))


def clean_title(c: Column) -> Column:
    """White space collapsed, edge punctuation off, 200 characters at most; empty and placeholder titles are null."""
    t = strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), r"^[\s.,;:_-]+|[\s,;:_-]+$", ""))
    return F.when(~F.lower(t).isin("", "unknown", "untitled", "none", "null", "n/a"), F.left(t, F.lit(200)))


def is_document_id(c: Column) -> Column:
    """Whether a title is only an identifier: a DOI, a hash, a code, or mostly digits."""
    digits = share(F.length(F.regexp_replace(c, "[^0-9]", "")), F.length(c))
    return c.rlike(r"^10\.\d{4,9}/") | c.rlike(r"^[0-9a-fA-F]{16,}$") | c.rlike(r"^[A-Z]{2,6}[-_ ]?\d{3,}$") | (digits > 0.5)


def snippet(c: Column, n: int = 240) -> Column:
    """White space collapsed, cut with an ellipsis."""
    t = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - 3)), F.lit("..."))).otherwise(t)


def highlight(df: DataFrame, text: str, term: str) -> DataFrame:
    """Rows that hold a term, split at its first place: before, match, after."""
    at = F.instr(F.lower(F.col(text)), F.lit(term.lower()))
    return df.where(at > 0).select("*", F.substring(F.col(text), F.lit(1), at - 1).alias("before"), F.substring(F.col(text), at, F.lit(len(term))).alias("match"), F.substring(F.col(text), at + len(term), F.length(text)).alias("after"))


def best_chunk(chunked: DataFrame, keywords: list[str]) -> DataFrame:
    """doc_id, chunk_index, score: the chunk with the most keyword hits per 1000 characters, longer ones ahead a little."""
    hits = sum((count_matches(F.lower(F.col("content")), rf"\b{k}\b") for k in keywords), F.lit(0))
    n = F.length("content")
    score = hits * 1000.0 / F.greatest(n, F.lit(1)) + F.least(F.lit(1.0), n / 2000.0)
    scored = chunked.select("doc_id", "chunk_index", F.floor(score * 1_000_000 + 0.5).cast("long").alias("score"))
    return scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("chunk_index")).alias("k"))).alias("b")).select("doc_id", (-F.col("b.k")).alias("chunk_index"), "b.score")


def domain_relevant(c: Column, terms: list[str], excluded: list[str], least: int = 50) -> Column:
    """Long enough, with a term and without an excluded one."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return (F.length(t) >= least) & t.rlike(r"\b(" + "|".join(terms) + r")\b") & ~t.rlike(r"\b(" + "|".join(excluded) + r")\b")


def drop_references(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, chunk_index, content) before the first that opens its references within its first 20 lines."""
    lines = F.slice(F.split("content", "\n"), 1, 20)
    mark = F.exists(lines, lambda x: (F.length(x) < 50) & x.rlike(r"(?i)^\s*(references|bibliography|literature cited)\s*:?\s*$"))
    first = pages.where(mark).groupBy("doc_id").agg(F.min("chunk_index").alias("stop"))
    return pages.join(first, "doc_id", "left").where(F.col("stop").isNull() | (F.col("chunk_index") <= F.col("stop"))).drop("stop")


def clean_segment(c: Column, least: float = 0.3) -> Column:
    """Without noise lines among the first ten; the original where under ``least`` of it would be left."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    noise = lambda x: x.rlike(r"(?i)^\s*(page \d+|\d+|doi:.*|https?://\S+|copyright.*|©.*)\s*$")
    kept = F.array_join(F.filter(lines, lambda x, i: (i >= 10) | ~noise(x)), "\n")
    return F.when(F.length(kept) < least * F.length(c), c).otherwise(kept)


def json_part(c: Column) -> Column:
    """The JSON object inside a model's answer: a fenced block's, else from the first to the last brace; null if neither parses."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    whole = F.regexp_replace(F.when(fenced != "", fenced).otherwise(braces), r"[\x00-\x1f]", " ")
    return F.when(F.get_json_object(whole, "$").isNotNull(), whole)


def document_key(path: Column, text: Column) -> Column:
    """16 hex characters from a path and the text's sha1."""
    return F.left(F.sha1(F.concat(path, F.sha1(text.cast("binary"))).cast("binary")), F.lit(16))


def question_hash(c: Column) -> Column:
    return F.left(F.sha2(c.cast("binary"), 256), F.lit(12))
