"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python task holds as Python or numpy objects at once.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder path that the driver and all executors see, in ``spark.checkpoint.dir``.

    Only on one machine may that be unset (tests): then it lies in a temporary folder, which is also
    set as the session's checkpoint folder. On a cluster a missing setting is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="marlspring-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_MADE: ContextVar[dict[str, DataFrame] | None] = ContextVar("made", default=None)


#: A page ends after any row that fills it; else a page has a hundred rows at least, however long.
LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def written(df: DataFrame, **options: str) -> DataFrame:
    """Cuts the lineage: writes the frame as a table in the shared folder, with the writer's options, and reads it back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    if (made := _MADE.get()) is not None:
        made[path] = back
    return back


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``written`` makes within the block are removed at its end, but for those handed to the function it gives."""
    made: dict[str, DataFrame] = {}
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(path for path, made_df in made.items() if made_df is df)
        return df

    token = _MADE.set(made)
    try:
        yield keep
    finally:
        _MADE.reset(token)
        for path in made.keys() - kept:
            remove(spark, path)
        if (outer := _MADE.get()) is not None:
            outer.update({path: made[path] for path in kept})


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame, written with a number of its own for each row, and the name of that column."""
    name = "_row"
    while name in df.columns:
        name += "_"
    return written(df.withColumn(name, F.monotonically_increasing_id())), name


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, actions hand Python tasks at most so many rows at a time (long rows, bounded memory)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Hands memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function of ``mapInArrow`` whose task ends by giving memory back: Spark keeps idle Python workers, and they what they hold."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Zero-copy runs of a batch whose texts together have about ``limit`` bytes at most (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    offsets = pc.cumulative_sum(pc.fill_null(pc.binary_length(column), 0)).to_pylist()
    start, base = 0, 0
    for i, total in enumerate(offsets):
        if total - base > limit and i > start:
            yield batch.slice(start, i - start)
            start, base = i, offsets[i - 1]
    if start < batch.num_rows:
        yield batch.slice(start)


def text_of(df: DataFrame, *extra: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns a text operator reads, so that no clashing extra column reaches it."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in extra])


def environment() -> None:
    """Libraries inside tasks use one thread each; Spark deals out the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
