"""What is told of results: sections of free text, insights over measures, averages of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspring.functions.scalars import strip

#: From which measure on a correlation, a trend (r squared) and a rate of anomalies are worth a word.
BOUNDS = {"correlation": 0.8, "trend": 0.7, "anomaly": 0.1}


def sections(rows: DataFrame, key: list[str], text: str, marks: list[tuple[str, list[str]]], repeated: tuple[str, ...] = ()) -> DataFrame:
    """key, section, pos, field, value of the ``field: value`` lines of texts.

    A line that holds a word of a section (the first such section, any case) opens it, that line included; lines
    before any belong to none and are left out. Of a field that comes again the last value counts, but sections named
    in ``repeated`` keep all. Null and empty texts have no rows; keys are unique.
    """
    line = F.lower("line")

    def opens() -> Column:
        told = F.lit(None).cast("string")
        for name, words in reversed(marks):
            told = F.when(F.greatest(*[line.contains(w.lower()) for w in words], F.lit(False)), name).otherwise(told)
        return told

    lines = rows.select(*key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "raw"))
    lines = lines.select(*key, F.col("pos").cast("long").alias("pos"), strip(F.col("raw")).alias("line")).where("line <> ''")
    so_far = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    told = lines.withColumn("section", F.last(opens(), ignorenulls=True).over(so_far)).where(F.col("section").isNotNull() & F.contains("line", F.lit(":")))
    at = F.instr("line", ":")
    told = told.select(*key, "section", "pos", strip(F.expr("substring(line, 1, instr(line, ':') - 1)")).alias("field"), strip(F.col("line").substr(at + 1, F.length("line"))).alias("value"))
    again = Window.partitionBy(*key, "section", "field").orderBy(F.desc("pos"))
    return told.withColumn("_k", F.row_number().over(again)).where((F.col("_k") == 1) | F.col("section").isin(*repeated)).drop("_k")


def insights(measures: DataFrame, bounds: dict[str, float] = BOUNDS, k: int = 3) -> DataFrame:
    """kind, n, items: for each kind of measures (kind, name, measure) over its bound how many, and the k strongest by size, then name.

    Kinds without a bound, and measures that are null or not a number, tell nothing.
    """
    size = F.abs(F.col("measure").cast("double"))
    bound = F.coalesce(*[F.when(F.col("kind") == kind, b) for kind, b in bounds.items()])
    strong = measures.select("kind", "name", size.alias("size")).where((F.col("size") > bound) & ~F.isnan("size"))
    n = strong.groupBy("kind").agg(F.count("*").alias("n"))
    first = strong.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("size"), "name"))).where(F.col("place") <= k)
    items = first.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("i"))
    return n.join(items, "kind").select("kind", "n", F.array_join("i.name", "; ").alias("items"))


def averages(rows: DataFrame, record: str, columns: list[str]) -> DataFrame:
    """record, measure, n (values that are not null), average (0 without any): one row a column, in one pass."""
    told = rows.agg(*[x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"a_{c}"))])
    return told.select(F.inline(F.array(*[F.struct(F.lit(record).alias("record"), F.lit(c).alias("measure"), F.col(f"n_{c}").alias("n"), F.col(f"a_{c}").alias("average")) for c in columns])))
