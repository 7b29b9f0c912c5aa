"""A training-data pipeline over ``documents``: five stages, each an operator of ``marlspring.llm``.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read back
as the next stage's input. The first four keep the columns of the documents that stay. What stays is
decided for each row: rows without an id or with one that others have too are documents of their own. A
null or empty text has no language, so the first stage drops it; an empty table stays empty; extra
columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspring.llm.bpe import bpe_digests
from marlspring.llm.common import numbered, shared_dir, table
from marlspring.llm.decontamination import decontaminated
from marlspring.llm.language import language_filter
from marlspring.llm.quality import quality_filter
from marlspring.llm.queries import tokenizer_path
from marlspring.llm.similarity import jaccard_components

#: SQL cannot express the language stage; tests/llm holds the stages against brute force.
ORACLE_SQL = None
#: Rows that a reader and a Python task hold at once: 1000 texts are about the slice that an operator works on; Spark's own 4096 and 10,000 took
#: tens of MB in each task, on the heap and beside it.
ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "1000", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def bounded(stage: Callable) -> Callable:
    """A stage whose session reads texts ``ROWS`` at a time; that stays set, as the caller writes what a stage returns. No result depends on it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, rows in ROWS.items():
            spark.conf.set(name, rows)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known (a null text's never is); the model learns from the stage's own input."""
    return language_filter(docs)


@bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base measures and every rule of the cascade; copies pass or fail together."""
    return quality_filter(docs)


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the least doc_id, a null one last."""
    rows, number = numbered(docs)
    found = jaccard_components(rows.select(F.col(number).alias("doc_id"), "text")).select(F.col("doc_id").alias(number), "component_id")
    # Rows that repeat an id stand apart by their numbers.
    order = rows.select(number, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", number).alias("_order"))
    stay = found.join(order, number).groupBy("component_id").agg(F.min("_order").alias("_order")).select(F.col(f"_order.{number}").alias(number))
    return rows.join(stay, number, "left_semi").select(*docs.columns)


@bounded
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; a text without words holds none."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


@bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id (null or repeated as in the input), n_tokens and the digests of the ids and of the decoded text, a row for each document."""
    return bpe_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
