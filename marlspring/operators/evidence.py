"""Evidence of a document: what kind a chunk is, a place among the picked chunks for special evidence, and classes named outright.

Picks under a must-include rule are settled by two aggregates a document (is something special picked, which chunk would be first to
come in), so a document's chunks are never gathered in a row. Defined results: null contents are of no kind and never come in;
chunks of one rank are taken by their index; a document without scored chunks has no picks; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspring.functions.scalars import strip

#: What kinds of chunks hold, in lower case, and the classes that a text names outright.
FRONT_MATTER = ["article history", "received ", "accepted ", "available online", "department of", "university", "corresponding author", "keywords:", "email:"]
TABLE_OR_CAPTION = ["table ", "tables ", "table 1", "table 2", "fig.", "figure ", "caption"]
ANALYTICAL = ["detected", "identified", "quantitation limit", "detection limit", "abundance", "abundances", "peak", "peaks", "gc-ms", "gc×gc", "lc-ms", "mass spectrometry", "extracts", "analytes"]
METHODS = ["materials and methods", "methods", "experimental", "procedure", "protocol", "sample preparation", "qa/qc", "quality assurance"]
CONTAMINATION = ["contamination", "blank", "control", "sterile", "dnase", "clean room", "curation", "handling", "quality control", "quality-control", "freezer", "foil", "protocol", "assessment"]
CLASSES = [
    (r"(?i)\b(dimethylsulfides?|dimethyl sulfides?)\b", "dimethylsulfides"), (r"(?i)\b(volatile organic compounds?)\b", "volatile organic compounds"),
    (r"(?i)\b(primordial organic matter)\b", "primordial organic matter"),
]


def holds(c: Column, hints: list[str]) -> Column:
    """Whether a text holds one of some hints, whatever its case; null holds none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for h in hints:
        out = out | low.contains(h)
    return out


def reference_like(c: Column) -> Column:
    """A list of references: it says so, has two ``et al``, a DOI with two years, or five years."""
    low = F.lower(F.coalesce(c, F.lit("")))
    years = F.regexp_count(low, F.lit(r"\b(?:19|20)\d{2}\b"))
    return low.contains("references") | (F.regexp_count(low, F.lit(" et al")) >= 2) | (low.contains("doi") & (years >= 2)) | (years >= 5)


def named_classes(c: Column, classes: list[tuple[str, str]] = CLASSES) -> Column:
    """The classes a text names outright, in the order of the table."""
    t = F.coalesce(c, F.lit(""))
    return F.array_distinct(F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(name)) for p, name in classes])))


def special(c: Column, field: str, boost: bool = False, classes: list[tuple[str, str]] = CLASSES) -> Column:
    """Whether a chunk is special evidence for a field (``organic_compounds`` or ``contamination_controls``; of others none is)."""
    if field == "organic_compounds":
        strong = F.size(named_classes(c, classes)) > 0 if boost else F.lit(False)
        return strong | holds(c, TABLE_OR_CAPTION) | holds(c, ANALYTICAL)
    return holds(c, TABLE_OR_CAPTION) | holds(c, METHODS) | holds(c, CONTAMINATION) if field == "contamination_controls" else F.lit(False)


def with_special(scored: DataFrame, key: str, index: str, most: int, is_special: Column, is_reference: Column, is_strong: Column | None = None) -> DataFrame:
    """The picks of each key with special evidence among them, if there is some: key, index, place, swapped (columns of ``scored`` stay).

    scored: key, index, rank (place among all scored chunks) and place (among the picks, from 1; null if not picked). Where no pick is special
    (or, with ``is_strong``, none is strong), the first chunk by rank that is special, not picked and no list of references comes
    in: at the end if picks are fewer than ``most``, else instead of the last.
    """
    rows = scored.withColumns({"_special": F.coalesce(is_special, F.lit(False)), "_reference": F.coalesce(is_reference, F.lit(False))})
    enough = F.coalesce(is_strong, F.lit(False)) if is_strong is not None else F.col("_special")
    whole = Window.partitionBy(key)
    picked = F.col("place").isNotNull()
    rows = rows.withColumns({
        "_settled": F.max(picked & F.col("_special") & enough).over(whole), "_n": F.max("place").over(whole),
        "_first": F.min(F.when(~picked & F.col("_special") & ~F.col("_reference"), F.struct("rank", index))).over(whole),
    })
    joins = ~F.coalesce("_settled", F.lit(False)) & ~picked & (F.struct("rank", index) == F.col("_first"))
    full = F.coalesce("_n", F.lit(0)) >= most
    rows = rows.withColumn("swapped", F.coalesce(joins, F.lit(False)))
    out = ~F.coalesce("_settled", F.lit(False)) & F.col("_first").isNotNull() & full & (F.col("place") == most)
    place = F.when(F.col("swapped"), F.least(F.coalesce("_n", F.lit(0)) + 1, F.lit(most))).otherwise(F.col("place"))
    kept = (picked & (F.col("place") <= most) & ~F.coalesce(out, F.lit(False))) | F.col("swapped")
    return rows.where(kept).withColumn("place", place.cast("long")).drop("_special", "_reference", "_settled", "_n", "_first")


def augmented(rows: DataFrame, evidence: DataFrame, key: str, tokens: str, title: str, classes: list[tuple[str, str]] = CLASSES, most: int = 16) -> DataFrame:
    """key, tokens: a record's tokens with the classes that its title and its evidence (key, place, content) name, each once, ``most`` at most.

    Lists of references are no evidence. What a chunk names is found where the chunk lies; only names are brought together, and their number
    is that of the classes.
    """
    said = evidence.where(~reference_like(F.col("content"))).select(key, "place", F.posexplode(named_classes(F.col("content"), classes)).alias("_pos", "_name"))
    first = said.groupBy(key, "_name").agg(F.min(F.struct("place", "_pos")).alias("_at"))
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_name"))).alias("_l")).select(key, F.col("_l._name").alias("_more"))
    none = F.array().cast("array<string>")
    own = F.filter(F.transform(F.split(F.coalesce(F.col(tokens), F.lit("")), ";"), strip), lambda x: x != "")
    every = F.array_distinct(F.concat(own, named_classes(F.col(title), classes), F.coalesce("_more", none)))
    return rows.join(lists, key, "left").select(key, F.array_join(F.slice(every, 1, most), "; ").alias("tokens"))
