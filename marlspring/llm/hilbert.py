"""Operator 7: shards cut from a Hilbert-curve ordering of several metadata dimensions.

Each dimension is quantised at equal-depth cuts over all rows; the cell's index on a Hilbert curve
orders the rows, so that rows near each other in every dimension share files and a reader can skip
files by any of them. The order is made by one range exchange of narrow rows; positions come from a
count for each range, so no task or driver ever holds all rows. Runs of the order are cut by the law
``rows``: shard counts are at most one apart.

Defined results: nulls quantise to the lowest cell; ties on the curve are ordered by the text's crc32
(equal texts stand together), then doc_id, so a cell with a third of all rows is still split between
tasks and shards; an empty table gives no rows; with fewer rows than shards the last shards are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from marlspring.llm.common import written


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of rows of cells (n x d, each below 2**bits): Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def text_rank(c: Column) -> Column:
    """A number that keeps the order of a string's first seven bytes."""
    return F.conv(F.rpad(F.substring(F.hex(F.coalesce(c, F.lit(""))), 1, 14), 14, "0"), 16, 10).cast("double")


def hilbert_shards(rows: DataFrame, dimensions: dict[str, Column], tie: list[str], shards: int, bits: int = 6) -> DataFrame:
    """Adds hilbert (long), shard (int) and slot (long, gapless from 0 in each shard) to narrow rows."""
    names = [f"_dim{k}" for k in range(len(dimensions))]
    framed = rows.select("*", *[F.coalesce(c.cast("double"), F.lit(float("-inf"))).alias(n) for n, c in zip(names, dimensions.values())])
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = framed.agg(*[F.percentile_approx(n, steps, 10_000).alias(n) for n in names]).first()  # one row of cuts
    edges = [np.unique(np.array(cuts[n] or [], dtype=float)) for n in names]
    kept = [f for f in framed.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.stack([np.searchsorted(e, batch.column(len(kept) + k).to_numpy(zero_copy_only=False), side="right") for k, e in enumerate(edges)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(hilbert_index(cells, bits))], [*(f.name for f in kept), "hilbert"])

    schema = StructType([*kept, StructField("hilbert", LongType())])
    numbered = StructType([*schema.fields, StructField("_part", IntegerType()), StructField("_at", LongType())])
    order = ["hilbert", *tie]
    dealt = framed.mapInArrow(run, schema).repartitionByRange(*order).sortWithinPartitions(*order)

    # The place within a range is fixed by writing it: a task numbers its sorted rows as they pass.
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "_part", "_at"])
            at += n

    placed = written(dealt.mapInArrow(number, numbered))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_held"))
    # One row for each range: small at every size.
    offsets = parts.select("_part", (F.sum("_held").over(Window.orderBy("_part")) - F.col("_held")).alias("_before"), F.sum("_held").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_before") + F.col("_at")
    shard = F.expr(f"(_before + _at) * {shards} div _all")
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("shard", shard)
        .withColumn("slot", rank - first)
        .select(*[F.col(f.name) for f in kept], "hilbert", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder for each shard with rows in curve order, for pruning by any dimension."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.col("lang").alias("lang"),
        F.col("source").alias("source"),
    )
    placed = hilbert_shards(rows, {"size": F.col("size"), "lang": text_rank(F.col("lang")), "source": text_rank(F.col("source"))}, ["text_crc32", "doc_id"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
