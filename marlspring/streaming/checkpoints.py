"""Checkpoints of many tasks in one folder: written, loaded, counted and pruned as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Versions of a task that pruning leaves.
KEEP = 20


def _where(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write(states: DataFrame, base: str) -> None:
    """One file for each row of states (task, version, and the fields of its state); no rows are exchanged.

    A version is written once: one that is there already makes a second file, of which ``latest`` takes either.
    """
    fields = [c for c in states.columns if c not in ("task", "version")]
    states.select("task", "version", F.to_json(F.struct(*fields)).alias("value")).write.mode("append").partitionBy("task", "version").text(base)


def read(spark: SparkSession, base: str) -> DataFrame:
    """task, version, value (JSON), file, size; no rows where the folder isn't there."""
    at, fs = _where(spark, base)
    if not fs.exists(at):
        return spark.createDataFrame([], "task string, version long, value string, file string, size long")
    rows = spark.read.schema("value string, task string, version long").option("wholetext", "true").text(base)
    return rows.select("task", "version", "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))


def latest(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """task, version and the state's fields of each task's newest version; fields that can't be read are null."""
    newest = read(spark, base).groupBy("task").agg(F.max(F.struct("version", "value")).alias("n"))
    return newest.select("task", "n.version", F.from_json(F.rtrim("n.value"), schema).alias("s")).select("task", "version", "s.*")


def statistics(spark: SparkSession, base: str, tasks: DataFrame) -> DataFrame:
    """task, has_checkpoints, checkpoints, latest_time (the newest state's created_at), total_size in bytes and MB (two decimals).

    A task without checkpoints has zeros and a null time; a newest state that can't be read has a null time too.
    """
    held = read(spark, base).groupBy("task").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max(F.struct("version", "value")).alias("newest"))
    n, size = F.coalesce("n", F.lit(0)), F.coalesce("bytes", F.lit(0))
    return tasks.select("task").distinct().join(held, "task", "left").select(
        "task", (n > 0).alias("has_checkpoints"), n.alias("checkpoints"), F.get_json_object("newest.value", "$.created_at").alias("latest_time"),
        size.alias("total_size"), F.round(size / (1 << 20), 2).alias("total_size_mb"),
    )


def prune(spark: SparkSession, base: str, keep: int = KEEP) -> int:
    """Deletes all but each task's newest versions and tells how many files went; only their names pass the driver, one by one."""
    w = Window.partitionBy("task").orderBy(F.desc("version"), F.desc("file"))
    old = read(spark, base).select("task", "version", "file").withColumn("k", F.row_number().over(w)).where(F.col("k") > keep)
    gone = 0
    for r in old.select(F.url_decode("file").alias("raw"), "file").toLocalIterator():
        at, fs = _where(spark, r.file)
        if not fs.exists(at):  # names come escaped
            at, fs = _where(spark, r.raw)
        gone += int(fs.delete(at, False))
    return gone
