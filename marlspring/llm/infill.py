"""Operator 13: fill-in-middle transformation of texts, cut at units.

A unit grammar says where one unit ends and the next begins by the classes of the neighbouring characters, so each grammar is
a zero-width regex of lookarounds: Spark's ``split`` at it keeps every piece as it is. The empty text has no units and is
taken apart from the others, as ``split`` would give it one empty piece. Only built-in functions are used; a row is worked on alone.

Defined results: a null text is the empty text; a null id is hashed as ``null``; rows that repeat an id get the same cuts and form; an
empty table gives no rows; extra columns stay out; a text of any length is one array of its units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
#: Classes of the characters left and right of a boundary, a pair for each kind of boundary.
ANY = r"[\s\S]"
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "char": [(ANY, ANY)],
    "line": [(r"\n", ANY)],  # [^\n]*\n|[^\n]+
    "word": [(r"\s", r"\S")],  # \S+\s*|\s+
    "run": [(r"\s", r"\S"), (r"\S", r"\s")],  # \S+|\s+
    "sentence": [("[.!?]", "[^.!?]")],  # [^.!?]*[.!?]+|[^.!?]+
}
#: No boundary parts the two halves of a character beyond the basic plane.
_WHOLE = r"(?<![\uD800-\uDBFF](?=[\uDC00-\uDFFF]))"


def boundary(grammar: str) -> str:
    """The zero-width regex of a grammar's boundaries."""
    found = "|".join(f"(?<={left})(?={right})" for left, right in GRAMMARS[grammar])
    return f"{_WHOLE}(?:{found})"


def units(text: Column, grammar: str) -> Column:
    """The units of a text, in order; none if it is empty."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def _drawn(seed: int) -> list[Column]:
    """Four numbers from the hash of an id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, grammar: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix, middle, suffix (null if plain) and output for each row of doc_id, text.

    ``rate`` of a hundred texts are cut, ``spm_rate`` of a hundred of those with the suffix first.
    """
    h1, h2, h3, h4 = _drawn(seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = rows.select("doc_id", "text", units(F.col("text"), grammar).alias("u"))
    cut = cut.select("*", F.size("u").cast("long").alias("n"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (h3 % 100 >= rate)
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = cut.select("*", F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm").alias("form"), F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b"))
    piece = lambda first, last: F.when(F.col("form") != "plain", F.array_join(F.slice("u", first + 1, last - first), ""))
    cut = cut.select("doc_id", "text", "n", "form", piece(F.lit(0), F.col("a")).alias("prefix"), piece(F.col("a"), F.col("b")).alias("middle"), piece(F.col("b"), F.col("n").cast("int")).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return cut.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from; the markers can't stand in a cut text."""
    body = F.substr(output, F.lit(4))
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    # The cuts lie before the first second marker and the first middle marker.
    one = F.split_part(body, second, F.lit(1))
    rest = F.substr(body, F.length(one) + 4)
    two = F.split_part(rest, F.lit(MIDDLE), F.lit(1))
    middle = F.substr(rest, F.length(two) + 4)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def infill_digests(docs: DataFrame, grammar: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, lengths in code points and digests of the output and of what is rebuilt from it."""
    made = fill_in_middle(docs, grammar, seed, rate, spm_rate)
    sha = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
