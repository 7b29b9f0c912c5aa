"""Operator 2 [native]: quality rules as a short-circuit cascade, in DataFrame functions only.

Base measures are counted for every text inside its own row (no shuffle, no Python). Repeated 3-word
windows are found by sorting the windows' hashes together with their positions: where two neighbours
share a hash, both windows mark their words. The further rules are put in an order by what a sample
says of each: its cost, the weighted characters its functions pass over in the documents that come to it,
and how many of those it rejects; the rule with the most rejections per cost comes next, and the cascade
stops at the first rule that rejects. One job over the sample tells both for all rules, and the same table
always gives the same order. The order changes the work and ``failed_rule``, never the verdict.

Words are runs of characters other than the space and \\t to \\r. Defined results: null and empty texts
have no words, so they fail the base; a text with under three words has no windows; repeated rows
give repeated rows; an empty table gives no rows; extra columns are ignored unless asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, in expectation, of the sample that orders the rules.
SAMPLE_ROWS = 2000
#: Costs of a comparison of measures and, for each character, of plain functions and of regular expressions.
COMPARE, PLAIN, REGEX = 1, 1, 10
_INDEX_BITS = 24


@dataclass(frozen=True)
class Rule:
    """A rule that rejects where ``rejects`` holds; ``cost`` is the work it makes of a document."""

    name: str
    rejects: str
    cost: str = f"{COMPARE}"


#: The base: what fails it is not kept.
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: The further rules, over the base measures, n_lines, and the text.
RULES = (
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("shouting", "2 * (length(text) - length(replace(text, '!', ''))) > n_words", f"{3 * PLAIN} * length(text)"),
    Rule("capitals", "2 * length(regexp_replace(text, '[^A-Z]', '')) > length(regexp_replace(text, '[^A-Za-z]', ''))", f"{2 * (REGEX + PLAIN)} * length(text)"),
    Rule("letters", r"2 * length(regexp_replace(text, '[^\\p{L}]', '')) < word_chars", f"{REGEX + PLAIN} * length(text)"),
    Rule("links", "5 * (length(text) - length(replace(text, '://', '//'))) > n_words", f"{3 * PLAIN} * length(text)"),
    Rule("ellipses", "2 * (length(text) - length(replace(text, '...', '..'))) > n_lines + 4", f"{3 * PLAIN} * length(text)"),
)


def _once(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Adds columns through a generator of one row, so that each is computed once, however often it is used."""
    one = F.array(F.struct(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(one))


def base_measures(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, and the columns to keep."""
    low = (1 << _INDEX_BITS) - 1
    df = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep if c != "text"])
    df = _once(df, _w=F.array_remove(F.split("text", r"[ \t-\r]+"), ""), _lines=F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0))
    df = _once(
        df,
        n_words="cast(size(_w) as bigint)",
        # Windows' hashes by position; a text of under three words has none.
        _t="transform(slice(_w, 1, greatest(0, size(_w) - 2)), (x, i) -> xxhash64(x, _w[i + 1], _w[i + 2]))",
    )
    df = _once(df, _distinct="size(array_distinct(_t))")
    # Hash and position in one number sort fastest; where cut hashes would clash, whole ones are sorted.
    # So they are in a text whose positions don't fit the bits left for them.
    df = _once(df, _clash=f"size(_t) > {low} OR _distinct < size(_t) AND size(array_distinct(transform(_t, h -> h & ~{low}L))) < _distinct")
    df = _once(
        df,
        _k=f"CASE WHEN _distinct < size(_t) AND NOT _clash THEN sort_array(transform(_t, (h, i) -> (h & ~{low}L) | cast(i as bigint))) ELSE array() END",
        _p="CASE WHEN _clash THEN sort_array(transform(_t, (h, i) -> struct(h AS h, i AS i))) ELSE array() END",
    )
    same = "({a} ^ {b}) BETWEEN 0 AND " + str(low)
    df = _once(
        df,
        _at=f"""CASE WHEN _clash THEN
              sort_array(filter(transform(_p, (x, j) -> if((j > 0 AND _p[j - 1].h = x.h) OR (j + 1 < size(_p) AND _p[j + 1].h = x.h), x.i, -1)), i -> i >= 0))
            ELSE sort_array(filter(transform(_k, (x, j) -> if((j > 0 AND {same.format(a='_k[j - 1]', b='x')}) OR (j + 1 < size(_k) AND {same.format(a='_k[j + 1]', b='x')}),
              cast(x & {low}L as int), -1)), i -> i >= 0)) END""",
    )
    return df.select(
        "doc_id",
        "text",
        "n_words",
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # Marked windows in order: each covers the words up to the next one, three at most.
        F.expr("aggregate(_at, struct(0L AS n, -3 AS last), (s, i) -> struct(s.n + least(3, i - s.last) AS n, i AS last), s -> s.n)").alias("n_repeat_words"),
        *[F.col(f"_keep_{c}") for c in keep if c != "text"],
    )


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost on a sample of about ``rows`` documents (dealt by the id's hash).

    Both are counted over what the rules before let pass. Equal rules come by their whole cost, then as given.
    """
    every = max(1, docs.count() // rows)
    sample = base_measures(docs.where(F.expr(f"pmod(xxhash64(doc_id), {every}) = 0"))).where(f"NOT ({BASE})")
    bits = " + ".join(f"if({r.rejects}, {1 << k}, 0)" for k, r in enumerate(rules)) or "0"
    work = [F.sum(F.expr(r.cost).cast("double")).alias(f"work_{k}") for k, r in enumerate(rules)]
    # One row for each set of rules that reject together.
    told = [(m, n, costs) for m, n, *costs in sample.groupBy(F.expr(bits).alias("m")).agg(F.count("*").alias("n"), *work).collect()]
    whole = [sum(costs[k] for _, _, costs in told) for k in range(len(rules))]
    order: list[Rule] = []
    left = set(range(len(rules)))
    while left:

        def worth(k: int) -> tuple[float, float, int]:
            rejected = sum(n for m, n, _ in told if m >> k & 1)
            return rejected / max(1.0, sum(costs[k] for _, _, costs in told)), -whole[k], -k

        best = max(left, key=worth)
        told = [x for x in told if not x[0] >> best & 1]
        left.remove(best)
        order.append(rules[best])
    return order


def quality_rules(docs: DataFrame, *keep: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The base measures, base_failed, kept and failed_rule (base, a rule's name, or null) of every document."""
    order = rule_order(docs, rules)
    failed = F.when(F.col("base_failed"), F.lit("base"))
    for r in order:
        failed = failed.when(F.expr(r.rejects), F.lit(r.name))
    judged = _once(base_measures(docs, *keep).withColumn("base_failed", F.expr(BASE)), failed_rule=failed)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule",
        *[F.col("text") if c == "text" else F.col(f"_keep_{c}").alias(c) for c in keep],
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their own columns; rows that repeat one or have a null id are judged one by one, and a null text never passes."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in others]).alias("_others"))
    kept = quality_rules(rows, "_others", "text").where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_others.{c}") for c in docs.columns])
