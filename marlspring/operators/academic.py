"""Metadata of a paper from its first page's text: DOI, year, journal, authors, title, abstract, keywords.

The title is read by a state machine over lines: heads (DOI, issue, page number) are passed, lines that are no title are
skipped, title lines are kept up to a line of authors, which ends them. Only built-in functions are used, a row each.

Defined results: a null or empty text has no metadata (all null); what isn't found is null; rows that repeat an id are read each on
its own; an empty table gives no rows; extra columns are ignored; only abstracts and keywords look beyond the first lines, so a long text is searched twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspring.functions.scalars import strip
from marlspring.operators.text import is_document_id

#: What is searched, and where a line or a name stands for something else than a title or a journal.
DOI = r"10\.\d{4,}/\S+"
FIRST, PAGE, HEAD, TITLE_LINES = 3000, 5000, 10, 25
ISSUE = r"[A-Z][a-zA-Z\s]+\s+\d+\s*\(\d{4}\)"
SKIPPED = [
    r"10\.\d{4,}/\S+", r"[A-Z][a-zA-Z\s]+\s+\d+\s*\(\d{4}\)", r"\d+\s*$", r"[0-9]{4}-?[0-9]{3,4}X", r"[A-Z0-9]+-[0-9]+-[0-9]+", r"[a-z]+[0-9]+-[0-9]+", r"[0-9]+\s+[0-9]+\s+[0-9]+$",
    "Abstract", "Keywords", "Introduction", r"[A-Z][a-z]+\s+[A-Z]\.\s*[A-Z][a-z]+", r"\d+\s*,\s*[A-Z][a-z]+", r"Received\s+", r"Accepted\s+", r"Published\s+", "Research Article", "Review Article",
    "Citation:", "arXiv:", r"AST-\d+", r"[A-Z]{2,}-\d{4}", r"[A-Z][a-z]+\s+[A-Z][a-z]+.*University", "Academic Editors:", "Editors:", r"TYPE\s+", r"DOI\s+", "OPEN ACCESS", "EDITED BY", "REVIEWED BY",
    "CORRESPONDENCE", "SPECIALTY SECTION", "This article was submitted to", "Frontiers in", "COPYRIGHT", r"©\s+\d{4}",
]
AUTHORS = r"[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s*,\s*[A-Z][a-z]+\s+[A-Z][a-z]+)*"
JOURNALS = [
    r"([A-Z][a-zA-Z\s&]+\s+(?:Journal|Review|Letters|Proceedings|Transactions|Bulletin|Magazine))", r"([A-Z][a-zA-Z\s&]+\s+\d+\s*\([0-9]{4}\))", r"([A-Z][a-zA-Z\s&]+,?\s*\d+)(?=\s*\()",
    r"([A-Z][a-zA-Z\s&]+\s+\d+[:\s]+\d+)", r"\b(Nature|Science|PNAS|Cell|Lancet|JAMA|NEJM)\b",
]
KNOWN = [
    "Nature", "Science", "PNAS", "Cell", "Lancet", "JAMA", "NEJM", "Astrophysical Journal", "Astronomy & Astrophysics", "Monthly Notices", "Icarus", "Geochimica et Cosmochimica Acta",
    "Meteoritics & Planetary Science", "International Journal of Astrobiology", "Astrobiology", "Origins of Life", "Earth and Planetary Science Letters", "Planetary and Space Science",
]
ABSTRACT = r"(?i)Abstract\s*([\s\S]*?)(?=\n\s*\n|\n\s*Keywords|\n\s*Introduction)"
KEYWORDS = r"(?i)Keywords?\s*:\s*([^\n]+)"


def _found(c: Column) -> Column:
    return F.when(c != "", c)


def doi(text: Column) -> Column:
    return _found(F.regexp_extract(text, f"({DOI})", 1))


def year(text: Column, this_year: int) -> Column:
    """The latest year from 1900 on that isn't over ``this_year``; the digits of a DOI, whole or cut off, are no year."""
    years = F.transform(F.regexp_extract_all(F.left(text, F.lit(FIRST)), F.lit(r"10\.\d{4,}(?:/\S*|$)|\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.try_cast("int"))
    return F.array_max(F.filter(years, lambda y: y <= this_year))


def _names_a_journal(c: Column) -> Column:
    """Whether a text may be a journal's name: letters enough, and neither an identifier nor a file's name."""
    low = F.lower(c)
    return ~is_document_id(c) & ~low.rlike(r"^[a-z]+\.[0-9]|^doi:|^essoar\.|^[a-z]\.$|^[a-z]+\.[a-z]+\.[0-9]") & low.rlike("[a-z]{3,}")


def journal(text: Column) -> Column:
    """The DOI's middle part, else a known journal that the page names, else the first name before an issue or page number."""
    middle = F.regexp_replace(F.split(doi(text), "/")[1], "[0-9_-]+$", "")
    of_doi = F.when((F.length(middle) > 3) & _names_a_journal(middle), middle)
    page = F.left(text, F.lit(PAGE))
    known = F.coalesce(*[F.when(F.lower(page).contains(k.lower()), F.lit(k)) for k in KNOWN])
    named = []
    for p in JOURNALS:
        # A run of letters is tried from the starts of its words only, which finds the same first places.
        some = F.regexp_extract_all(page, F.lit(f"(?i)(?<![A-Za-z]){p}"), F.lit(1))
        clean = F.transform(some, lambda x: strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(x), r"\s+\d+[:\s()].*$", ""), r",\s*\d+.*$", ""), r"\s*\([^)]*\)\s*$", "")))
        named.append(F.get(F.filter(clean, lambda x: (F.length(x) > 3) & (F.length(x) < 100) & _names_a_journal(x)), F.lit(0)))
    return F.coalesce(of_doi, known, *named)


def authors(lines: Column) -> Column:
    """The names of the first line that holds some, among the first lines."""
    line = F.get(F.filter(F.slice(lines, 1, HEAD), lambda x: ~x.rlike("^(Abstract|ABSTRACT)") & x.rlike(AUTHORS) & (F.length(x) < 200)), F.lit(0))
    names = strip(F.regexp_replace(F.regexp_replace(F.regexp_extract(line, f"({AUTHORS})", 1), r"[^A-Za-z\s,]", ""), r"\s+", " "))
    return F.when(F.length(names) > 5, names)


def title(lines: Column) -> Column:
    """Title lines joined, from the last head line on; null if what is found is too short, too long or an identifier."""
    head = F.slice(lines, 1, HEAD)
    passed = F.aggregate(F.transform(head, lambda x, i: F.when(x.rlike(rf"{DOI}|{ISSUE}|^\d+\s*$"), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))
    is_title = lambda x: (
        (F.length(x) > 10) & (F.length(x) < 200) & (x != F.upper(x)) & (x != F.lower(x)) & x.rlike("[A-Z]") & ~x.rlike(rf"(?i)^(?:{'|'.join(SKIPPED)})") & ~x.rlike(r"^\d+\s*,\s*[A-Z]|^[A-Z][a-z]+\s+[A-Z]\.\s*[A-Z]")
    )

    def step(s: Column, x: Column) -> Column:
        taken = F.struct(F.concat(s["kept"], F.array(x)).alias("kept"), x.rlike(f"^{AUTHORS}$").alias("done"))
        return F.when(s["done"] | ~is_title(x), s).otherwise(taken)

    run = F.aggregate(F.slice(lines, passed + 1, F.lit(TITLE_LINES)), start, step)
    whole = strip(F.regexp_replace(F.array_join(run["kept"], " "), r"\s+", " "))
    whole = F.regexp_replace(whole, r"[^\p{L}\p{N}_\s\-.,:;!?()]", "")
    digits = F.length(F.regexp_replace(whole, "[^0-9]", ""))
    code = whole.rlike(r"^[0-9]{4}-?[0-9]{3,4}X|^[A-Z0-9]+-[0-9]+-[0-9]+|^[0-9]+\s+[0-9]+\s+[0-9]+$") | ((digits > F.length(whole) * 0.5) & (F.length(whole) < 30))
    return F.when((F.length(whole) > 15) & (F.length(whole) < 500) & ~code, whole)


def abstract(text: Column) -> Column:
    found = strip(F.regexp_extract(text, ABSTRACT, 1))
    return F.when(F.length(found) > 50, found)


def paper_metadata(docs: DataFrame, this_year: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, doi, year, journal, authors, title, abstract, keywords of each text."""
    t = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select("*", F.transform(F.slice(F.split(F.left("t", F.lit(20 * PAGE)), "\n"), 1, HEAD + TITLE_LINES), strip).alias("lines"))
    c, lines = F.col("t"), F.col("lines")
    return t.select(
        key, doi(c).alias("doi"), year(c, this_year).cast("long").alias("year"), journal(c).alias("journal"), authors(lines).alias("authors"), title(lines).alias("title"), abstract(c).alias("abstract"),
        _found(F.regexp_extract(c, KEYWORDS, 1)).alias("keywords"),
    )
