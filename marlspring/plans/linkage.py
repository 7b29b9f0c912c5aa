"""Records made of documents, matched by several signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspring.functions.scalars import q6
from marlspring.operators import linkage as K
from marlspring.registry import register
from marlspring.session import table


def _records(spark, sf) -> DataFrame:
    """A document as a record: its first sentence names it, source, language and first word are its class, place and origin, its lines are what it refers to."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return table(spark, sf, "documents").select(
        "doc_id", F.split(F.coalesce("text", F.lit("")), r"[.\n]")[0].alias("name"), F.col("source").alias("class"), F.col("lang").alias("place"), F.split(lines[0], " ")[0].alias("origin"), F.array().cast("array<string>").alias("dois"), lines.alias("titles")
    )


@register("record_matches")
def record_matches(spark, sf):
    """The stated query set, documents whose id is divisible by 100, against all."""
    rows = _records(spark, sf)
    return K.record_matches(rows.where("doc_id % 100 = 0"), rows, "doc_id").withColumn("score", q6(F.col("score")))
