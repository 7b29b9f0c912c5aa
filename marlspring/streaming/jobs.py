"""Streams: hourly counts, frequent users, gated attempts, and resumable micro-batches over folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def folder(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """New files of a folder as a stream; what is done is kept in the query's checkpoint, so a restart resumes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, sum_value for each hour; works on streams (late rows up to a bound) and tables."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("sum_value")).select(F.col("window.start").alias("start"), "event_type", "n", "sum_value")


def frequent_users(events: DataFrame, more_than: int, length: str = "1 hour", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """start, user_id, n: users with over a bound of events in a sliding window."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length, slide), "user_id")
    return w.agg(F.count("*").alias("n")).where(F.col("n") > more_than).select(F.col("window.start").alias("start"), "user_id", "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def failure_gate(attempts: DataFrame, budget: int = 3) -> DataFrame:
    """item, attempt, allowed as attempts (item, attempt, failed) arrive: false once ``budget`` failures of the item went before."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (failures,) = state.get if state.exists else (0,)
        for rows in frames:
            rows = rows.sort_values("attempt")
            before = failures + rows["failed"].astype(int).cumsum().shift(fill_value=0)
            failures += int(rows["failed"].sum())
            yield pd.DataFrame({"item": key[0], "attempt": rows["attempt"], "allowed": before < budget})
        state.update((failures,))

    return attempts.groupBy("item").applyInPandasWithState(step, "item long, attempt long, allowed boolean", "failures long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is available to Parquet and stops; called again, it goes on where it stopped."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(target)
    q.awaitTermination()


def run_complete(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Writes the whole result after all that is available, windows still open included, and stops.

    A batch writes a folder of its own and the last one is moved to the target, so readers never see half a result.
    """
    spark = stream.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done: list[str] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}__{batch}")
        done.append(f"{target}__{batch}")

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    fs = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(conf)
    for path in done[:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
    if done:
        fs.delete(jvm.org.apache.hadoop.fs.Path(target), True)
        fs.rename(jvm.org.apache.hadoop.fs.Path(done[-1]), jvm.org.apache.hadoop.fs.Path(target))


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Calls work(rows, batch id) for each micro-batch; a batch that failed comes again with the same id."""
    q = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_polled(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds") -> StreamingQuery:
    """Calls work(rows, batch id) for what has come in since the last look, once an interval, until the query is stopped."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
