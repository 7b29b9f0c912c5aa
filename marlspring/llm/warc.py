"""Operator 4: WARC archives, written as text rows and read back by boundary-chain verification.

Writing: of records with equal payloads of ``REVISIT_BYTES`` or more, the one with the largest id is a
response and the others revisit it. Tasks join the records they read, in that order, to archives that end before
``FILE_BYTES`` would be passed; only a record longer than that makes a longer archive, of its own. An archive is one
row of text and one file, its last terminator the writer's line separator.

Reading: a task looks at its archives in blocks and emits, for each place that looks like a record's
start, the offset and that of the successor its length points to. Magic inside a payload also yields
such candidates. Within a block the candidates are followed up to the first offset outside; pointer
jumping over those block exits (each round doubles the distance) tells which blocks the chain from the
file's start enters and where, and only candidates on the chain from there are records. A header may be as
long as its archive; a file whose chain doesn't reach its end is an error. Candidates
carry no payload, blocks bound every group, and rounds grow with the logarithm of an archive's blocks.

Defined results: null html is an empty payload; null and control characters of a url are replaced in
the header; rows that share the largest id of a group are all responses; a null id is written as
``null``, never refers and is never referred to; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspring.llm.common import arrow_rows, written

#: The record magic and the terminator.
MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
REVISIT_BYTES = 1000
FILE_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
#: Records that a writing task is handed at a time.
BATCH_ROWS = 64
DATE = "2026-01-01T00:00:00Z"
_FIELD = re.compile(rb"^([A-Za-z-]+): *(.*?)\r?$", re.M)


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to for each row."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"),
    )
    # Written down, so that its size is known when Spark chooses how to join; only real groups are in it.
    groups = written(
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    )
    revisit = F.col("page_id") < F.col("_first")
    return rows.join(groups, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def _archives(file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joins records by their terminators to archives of ``file_bytes`` at most (one record at least)."""

    def row(archive: bytearray) -> pa.RecordBatch:
        ends = pa.py_buffer(np.array([0, len(archive)], np.int32))
        return pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(1, ends, pa.py_buffer(bytes(archive)))], ["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive: bytearray | None = None
        for batch in batches:
            for record in batch.column(0):
                added = record.as_buffer()
                if archive is not None and len(archive) + added.size + 2 * len(END) > file_bytes:
                    yield row(archive)
                    archive = None
                if archive is None:
                    archive = bytearray(added)
                else:
                    archive += END
                    archive += added
        if archive is not None:
            yield row(archive)

    return run


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes one record for each row of page_id, url, html."""
    marked = mark_revisits(pages)
    urn = "concat('<urn:marlspring:page:', coalesce(cast({} as string), 'null'), '>')"
    http = "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', payload_bytes, '\\r\\n\\r\\n')"
    record = F.expr(
        f"""concat('WARC/1.1\\r\\nWARC-Type: ', record_type,
          '\\r\\nWARC-Record-ID: ', {urn.format("page_id")},
          '\\r\\nWARC-Target-URI: ', regexp_replace(coalesce(url, 'urn:marlspring:none'), '[\\\\x00-\\\\x20\\\\x7f]', '%20'),
          '\\r\\nWARC-Date: {DATE}\\r\\nWARC-Payload-Digest: sha1:', payload_digest,
          if(record_type = 'revisit', concat('\\r\\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\\r\\nWARC-Refers-To: ', {urn.format("refers_to")}), ''),
          '\\r\\nContent-Type: application/http; msgtype=response\\r\\nContent-Length: ',
          octet_length({http}) + if(record_type = 'response', payload_bytes, 0), '\\r\\n\\r\\n', {http}, if(record_type = 'response', html, ''))"""
    )
    with arrow_rows(pages.sparkSession, BATCH_ROWS):
        archives = marked.select(record.alias("value")).mapInArrow(_archives(file_bytes), "value string")
        archives.write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).text(path)


class _Headers:
    """The headers of one archive, looked up at rising offsets; each byte is searched once, however long a header is."""

    def __init__(self, content: bytes):
        self.content, self.stop, self.fields = content, -1, {}

    def at(self, at: int) -> tuple[int, dict[bytes, bytes]] | None:
        """(offset behind the header, its fields) if a header stands at an offset."""
        begin = at + len(MAGIC)
        if self.stop < at:
            self.stop = self.content.find(END, at)
            if self.stop < 0:
                self.stop = len(self.content)
            # Of a repeated field the last one counts, so headers with one end share these.
            self.fields = {m[1].lower(): (m.start(), m[2]) for m in _FIELD.finditer(self.content, begin, self.stop)}
        if self.stop == len(self.content):
            return None
        return self.stop + len(END), {k: v for k, (where, v) in self.fields.items() if where >= begin}


def _id(urn: bytes | None) -> int | None:
    m = re.search(rb":page:(-?\d+)>", urn or b"")
    return int(m[1]) if m else None


FIELDS = [
    ("file", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("off", pa.int64()), ("next", pa.int64()), ("leaves", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
    ("payload_at", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()),
]
SCHEMA = "file string, size long, block long, off long, next long, leaves long, page_id long, url string, payload_at long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def candidates(spark: SparkSession, path: str, block: int = BLOCK_BYTES) -> DataFrame:
    """Every place of the archives that looks like a record, with its successor and where its chain leaves the block."""

    def look(file: str, content: bytes, begin: int, headers: _Headers) -> list[tuple]:
        found, stop, at = [], min(len(content), begin + block), begin
        while (at := content.find(MAGIC, at, stop + len(MAGIC) - 1)) >= 0:
            head = headers.at(at)
            if head and head[1].get(b"content-length", b"").isdigit():
                body, fields = head
                end = body + int(fields[b"content-length"])
                if content[end : end + len(END)] == END:
                    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
                    inner = content.find(END, body, end)
                    inner = body if inner < 0 else inner + len(END)
                    told = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace")
                    length = re.search(rb"Content-Length: (\d+)", content[body:inner])
                    digest = hashlib.sha1(content[inner:end]).hexdigest() if kind == "response" else told
                    size = end - inner if kind == "response" else int(length[1]) if length else None
                    url = fields.get(b"warc-target-uri", b"").decode("utf-8", "replace")
                    found.append([file, len(content), begin // block, at, end + len(END), 0, _id(fields.get(b"warc-record-id")), url, inner, size, digest, kind, _id(fields.get(b"warc-refers-to")), digest == told])
            at += 1
        leaves: dict[int, int] = {}
        for r in reversed(found):
            r[5] = leaves[r[3]] = leaves.get(r[4], r[4])
        if begin == 0 and (not found or found[0][3] != 0):
            raise ValueError(f"{file}: no record at the start")
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                name, raw = file.as_py(), content.as_py()
                headers = _Headers(raw)
                for begin in range(0, len(raw), block):
                    rows = look(name, raw, begin, headers)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), FIELDS)], [n for n, _ in FIELDS])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on the chain from their file's start, by pointer jumping over block exits."""
    longest = found.agg(F.max("next")).first()[0]
    if longest is None:
        return found
    blocks = found.agg(F.max("block")).first()[0] + 1
    exits = found.select("file", F.col("leaves").alias("off")).distinct()
    starts = found.select("file").distinct().withColumn("off", F.lit(0).cast("long"))
    jump = written(found.join(exits.union(starts).distinct(), ["file", "off"]).select("file", "off", F.col("leaves").alias("to")))
    reached = starts
    for _ in range(math.ceil(math.log2(blocks)) + 1):
        step = reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))
        reached = written(reached.union(step).distinct())
        further = jump.select("file", F.col("off").alias("to"), F.col("to").alias("beyond"))
        jump = written(jump.join(further, ["file", "to"]).select("file", "off", F.col("beyond").alias("to")))
    # A chain that is whole leaves its last block at the file's end.
    ends = found.select("file", F.col("size").alias("off")).distinct()
    if broken := ends.join(reached, ["file", "off"], "left_anti").select("file").first():
        raise ValueError(f"{broken.file}: the chain of records doesn't reach the file's end")
    entered = found.join(reached.withColumn("entry", F.lit(True)), ["file", "off"], "left")

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        after = dict(zip(rows["off"], rows["next"]))
        on: set[int] = set()
        for at in rows["off"][rows["entry"].eq(True)]:
            while at in after and at not in on:
                on.add(at)
                at = after[at]
        return pd.DataFrame({"file": rows["file"], "off": rows["off"]})[rows["off"].isin(on)]

    chain = entered.select("file", "block", "off", "next", "entry").groupBy("file", "block").applyInPandas(follow, "file string, off long")
    return found.join(chain, ["file", "off"], "left_semi")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact, file, off, payload_at."""
    found = written(candidates(spark, path))
    return reachable(found).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "file", "off", "payload_at")


def read_payloads(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """page_id and payload (text) of the response records given; an archive's records are cut out where it is read."""
    wanted = records.where("record_type = 'response'").groupBy("file").agg(F.collect_list(F.struct("page_id", "payload_at", "payload_bytes")).alias("at"))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content").join(wanted, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(batch.column(1), batch.column(2)):
                raw, places = content.as_py(), at.as_py()
                texts = [raw[p["payload_at"] : p["payload_at"] + p["payload_bytes"]].decode("utf-8", "replace") for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([p["page_id"] for p in places], pa.int64()), pa.array(texts, pa.string())], ["page_id", "payload"])

    return files.mapInArrow(run, "page_id long, payload string")
