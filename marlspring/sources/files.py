"""Readers and writers: checked JSONL and CSV inputs, a vector collection on Parquet, logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class InputError(ValueError):
    """An input breaks its contract; the message says how."""


def _refuse(bad: DataFrame, what: str) -> None:
    row = bad.first()
    if row is not None:
        raise InputError(f"{what}: {row.asDict()}")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, question from JSON lines; blank lines are skipped, missing fields and repeated ids refused."""
    schema = StructType([StructField("qid", StringType()), StructField("question", StringType()), StructField("_broken", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    df = lines.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}).alias("j"), "value").select("j.qid", "j.question", "value")
    _refuse(df.where("qid IS NULL OR question IS NULL OR qid = '' OR question = ''").select("value"), "a query needs qid and question")
    _refuse(df.groupBy("qid").count().where("count > 1"), "a query id is repeated")
    return df.drop("value")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, relevance 0..2 from CSV; equal repeats count once, conflicting ones are refused."""
    raw = spark.read.option("header", True).csv(path)
    missing = {"qid", "doc_id", "relevance"} - set(raw.columns)
    if missing:
        raise InputError(f"columns are missing: {sorted(missing)}")
    df = raw.select("qid", "doc_id", F.expr("try_cast(relevance AS INT)").alias("relevance"))
    _refuse(df.where("relevance IS NULL OR relevance NOT BETWEEN 0 AND 2"), "relevance is 0, 1 or 2")
    g = df.groupBy("qid", "doc_id").agg(F.min("relevance").alias("relevance"), F.max("relevance").alias("other"))
    _refuse(g.where("relevance <> other"), "judgments conflict")
    return g.drop("other")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, rank, score from JSON lines whose fields go by several names; a missing rank is the place in the line's list."""
    hit = "struct<doc_id:string,document_id:string,id:string,rank:int,position:int,idx:int,score:double>"
    schema = f"struct<qid:string,query_id:string,results:array<{hit}>,hits:array<{hit}>,documents:array<{hit}>>"
    j = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("j"))
    rows = j.select(F.coalesce("j.qid", "j.query_id").alias("qid"), F.posexplode(F.coalesce("j.results", "j.hits", "j.documents")).alias("at", "h"))
    named = rows.select("qid", F.coalesce("h.doc_id", "h.document_id", "h.id").alias("doc_id"), F.coalesce("h.rank", "h.position", F.col("h.idx") + 1, F.col("at") + 1).alias("rank"), "h.score")
    return named.where("qid IS NOT NULL AND doc_id IS NOT NULL")


def read_gold(spark: SparkSession, path: str, required: list[str], optional: list[str] = ()) -> DataFrame:
    """A CSV's required and optional columns (a byte-order mark in the first name is dropped, absent optional ones are null)."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    missing = set(required) - set(raw.columns)
    if missing:
        raise InputError(f"columns are missing: {sorted(missing)}")
    return raw.select(*required, *[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in optional])


def write_csv(df: DataFrame, path: str, columns: list[str], digits: int = 6) -> None:
    """Columns in order; doubles with fixed digits, nulls empty."""
    kinds = dict(df.dtypes)
    out = [F.format_string(f"%.{digits}f", F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    out = [F.when(F.col(c).isNotNull(), o).alias(c) for c, o in zip(columns, out)]
    df.select(*out).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, appended; each write is a file of its own, so writers never meet."""
    df.write.mode("append").json(path)


def markdown_table(df: DataFrame, columns: list[str], digits: int = 4, most: int = 200) -> str:
    """A small metrics frame as a Markdown table (a report: at most ``most`` rows are shown)."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " - |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in df.select(*columns).limit(most).collect()])


class Collection:
    """Chunks with vectors on Parquet, partitioned by a bucket of the document id.

    A version is a folder that never changes once its name is the current one's; a delete writes the next version
    and then its marker file, so a reader sees all of the old version or all of the new one, and
    a crash between leaves the old one.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._where = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._where(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _version(self) -> int:
        """The highest version whose marker was written."""
        if not self._fs.exists(self._where(self.path)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._where(self.path))]
        return max((int(n.removeprefix("current-")) for n in names if n.startswith("current-")), default=0)

    def _folder(self, version: int | None = None) -> str:
        return f"{self.path}/v{self._version() if version is None else version}"

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self._folder())

    def _bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.BUCKETS)).cast("int")

    def insert(self, chunks: DataFrame) -> None:
        chunks.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("bucket", self._bucket()).write.mode("append").partitionBy("bucket").parquet(self._folder())

    def scan(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        df = self._rows().drop("bucket")
        return df if limit is None else df.orderBy("doc_id", "chunk_index").offset(offset).limit(limit)

    def of_document(self, doc_id: int) -> DataFrame:
        """One document's chunks: its bucket's folder is read and the id reaches the scan's filters."""
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(doc_id).cast("long")), F.lit(self.BUCKETS)).alias("b")).first().b
        return self._rows().where((F.col("bucket") == bucket) & (F.col("doc_id") == doc_id)).drop("bucket")

    def delete(self, doc_ids: DataFrame) -> None:
        """The collection without the documents, as its next version; the old version's folder goes last."""
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        old = self._version()
        self._rows().join(gone, "doc_id", "left_anti").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(old + 1))
        self._fs.create(self._where(f"{self.path}/current-{old + 1}"), False).close()  # from here on the new version holds
        self._fs.delete(self._where(self._folder(old)), True)

    def count(self) -> int:
        return self._rows().count()

    def migrate(self, to: Collection) -> DataFrame:
        """Copies every chunk to another collection; gives the keys that did not arrive (none, if all is well)."""
        to.insert(self.scan())
        key = ["doc_id", "chunk_index"]
        return self.scan().select(*key).join(to.scan().select(*key), key, "left_anti")


def read_texts(spark: SparkSession, path: str, min_chars: int = 1, max_bytes: int = 50 << 20) -> DataFrame:
    """path, text, status of every file of a folder: ok, TOO_LARGE or NO_TEXT_EXTRACTED; no file stops the read.

    Spark's file sources skip files of zero bytes, so those have no row.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.decode("content", "UTF-8")
    status = F.when(F.col("length") > max_bytes, "TOO_LARGE").when(F.length(F.regexp_replace(text, r"\s+", "")) < min_chars, "NO_TEXT_EXTRACTED").otherwise("ok")
    return raw.select("path", status.alias("status"), F.when(status == "ok", text).alias("text"))
