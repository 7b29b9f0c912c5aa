"""Operator 5: benchmark decontamination as a prefix-filtered set join.

A window (n consecutive words of an item) is contained in a document only if all its shingles are, so
its necessary prefix is one shingle: the rarest by frequency over all documents. A first pass counts
the benchmark's shingles in all documents, a second emits the places of prefix shingles with the words
around them; they join the benchmark on the shingle, length and positional bounds drop what can't hold
a window, and the words themselves are compared for the exact answer.

What is broadcast is a bitmap of fixed size (``BITMAP_BITS``) over the benchmark's shingle hashes; it
only saves rows, the join decides. The join key may be hot on the documents' side; an item's windows
that share a prefix place are one row, so a place gives one candidate for each item place, and AQE
splits the key. Rows of a document meet again only as intervals.

Defined results: null and empty texts have no words and no hits; an item without words or without
an id takes no part; a repeated item counts once, and texts that share an item_id are all searched and
count as one item; overlapping hits count a word once; rows that repeat
a doc_id are documents of their own; an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspring.llm.common import lean, numbered, passing_tables, slices, text_of, written
from marlspring.llm.hashing import runs, word_hashes

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 3
#: Bits of the broadcast bitmap (4 MB), whatever the benchmark's size.
BITMAP_BITS = 1 << 25
#: Distinct shingles that a task counts before it passes its counts on.
COUNTED = 200_000
#: Places of a document in one row.
PLACES = 1000
#: Words are runs of other bytes once A-Z are lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def fold(text: str | None) -> bytes:
    return (text or "").encode().translate(_FOLD)


def benchmark_shingles(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Each shingle of each item: item_id, t (a digest of the item's words), n (their number), p (the shingle's start), h, k, and at p = 0 the words."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item_id", "t", "n", "p", "h", "k", "words"]
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = fold(text).split()
                if not words or item is None:
                    continue
                n, k = len(words), min(shingle, len(words))
                h = runs(word_hashes([b" ".join(words)])[0], k).astype(np.int64)
                m = len(h)
                t = hashlib.blake2b(b" ".join(words), digest_size=16).hexdigest()
                told = pa.array([[w.decode() for w in words], *[None] * (m - 1)], pa.list_(pa.string()))
                columns = [pa.array([item] * m, pa.string()), pa.array([t] * m), pa.array(np.full(m, n, np.int32)), pa.array(np.arange(m, dtype=np.int32)), pa.array(h), pa.array(np.full(m, k, np.int32)), told]
                yield pa.RecordBatch.from_arrays(columns, names)

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item_id string, t string, n int, p int, h long, k int, words array<string>")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits that are set for the hashes in column h: BITMAP_BITS / 64 rows at most reach the driver."""
    found = hashes.select(F.expr(f"shiftright(h & {BITMAP_BITS - 1}, 6)").alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    rows = found.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    bits[rows["at"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return bits.view(np.uint64)


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(BITMAP_BITS - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _places(texts: list[bytes], sizes: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word position, hash) of every shingle in the bitmap, and the word offsets by text."""
    hashes, ends = word_hashes(texts)
    who = np.repeat(np.arange(len(texts)), np.diff(ends))
    found = []
    for k in sizes:
        h = runs(hashes, k)
        at = np.flatnonzero(_in(bits, h)) if len(h) else np.zeros(0, np.int64)
        at = at[who[at] == who[at + k - 1]]
        found.append((who[at], at - ends[who[at]], h[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), ends
    return *(np.concatenate(x) for x in zip(*found)), ends


def shingle_frequency(docs: DataFrame, sizes: list[int], bits) -> DataFrame:
    """h, df: occurrences of the bitmap's shingles in all documents."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["h", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                _, _, h, _ = _places([fold(t) for t in part.column(1).to_pylist()], sizes, bits.value)
                values, counts = np.unique(h.astype(np.int64), return_counts=True)
                seen.update(dict(zip(values.tolist(), counts.tolist())))
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))


def prefix_places(docs: DataFrame, sizes: list[int], bits, window: int = WINDOW) -> DataFrame:
    """rid, doc_id, n_words of each document (own), and its places of prefix shingles: position, hash, and the words from ``lo`` on around it.

    A row holds ``PLACES`` places at most; a document with more has further rows.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        place = pa.struct([("pos", pa.int32()), ("h", pa.int64()), ("lo", pa.int32()), ("near", pa.list_(pa.string()))])
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(place))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], ["rid", "doc_id", "n_words", "own", "places"])

        for batch in batches:
            for part in slices(batch, "text"):
                texts = [fold(t) for t in part.column(1).to_pylist()]
                who, pos, h, ends = _places(texts, sizes, bits.value)
                order = np.argsort(who, kind="stable")
                who, pos, h = who[order], pos[order].tolist(), h[order].astype(np.int64).tolist()
                starts = np.searchsorted(who, np.arange(len(texts) + 1)).tolist()
                for i, (doc_id, n_words) in enumerate(zip(part.column(0).to_pylist(), np.diff(ends).tolist())):
                    first, last = starts[i], starts[i + 1]
                    words = texts[i].split() if last > first else []
                    for k in range(first, max(last, first + 1), PLACES):
                        found = [{"pos": p, "h": x, "lo": max(0, p - window + 1), "near": [w.decode() for w in words[max(0, p - window + 1) : p + window]]} for p, x in zip(pos[k : min(last, k + PLACES)], h[k : min(last, k + PLACES)])]
                        rows.append((rid, doc_id, n_words, k == first, found))
                        held += 1 + len(found)
                        if held > 16 * PLACES:
                            yield out()
                            rows.clear()
                            held = 0
                    rid += 1
        if rows:
            yield out()

    return docs.mapInArrow(run, "rid long, doc_id long, n_words long, own boolean, places array<struct<pos: int, h: long, lo: int, near: array<string>>>")


def prefixes(bench: DataFrame, frequency: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, h, p, w (words of a window), starts (of the windows whose rarest shingle this is), lo and span (the item's words from there on)."""
    rows = bench.select("item_id", "t", "n", "p", "h").distinct().join(frequency, "h", "left")
    ahead = Window.partitionBy("item_id", "t").orderBy("p").rowsBetween(0, window - shingle)  # the shingles of the window that starts here
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "p")).over(ahead)
    w = F.least(F.lit(window), F.col("n"))
    ranked = rows.select("item_id", "t", w.alias("w"), F.col("p").alias("s"), "n", rarest.alias("r")).where("s <= n - w")
    starts = ranked.groupBy("item_id", "t", "w", F.col("r.h").alias("h"), F.col("r.p").alias("p")).agg(F.collect_set("s").alias("starts"))
    words = bench.where("p = 0").select("t", "words").dropDuplicates(["t"])
    lo = F.array_min("starts")
    return starts.join(words, "t").select("item_id", "h", "p", "w", "starts", lo.alias("from"), F.slice("words", lo + 1, F.array_max("starts") + F.col("w") - lo).alias("span"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and rid (a number of the row)."""
    spark, docs = documents.sparkSession, text_of(documents)
    share = spark.sparkContext.broadcast
    with passing_tables(spark) as keep:
        bench = written(benchmark_shingles(benchmark, shingle))
        sizes = sorted(r.k for r in bench.select("k").distinct().collect())  # at most `shingle` values
        rare = keep(written(prefixes(bench, shingle_frequency(docs, sizes, share(bitmap(bench))), window, shingle)))
        found = keep(written(prefix_places(docs, sizes, share(bitmap(rare)), window)))
    place = found.where("size(places) > 0").select("rid", "n_words", F.explode("places").alias("q")).select("rid", "n_words", "q.*")
    # Item word p stands at document word pos, so the window at s starts at pos - p + s.
    starts = F.expr(
        "transform(filter(starts, s -> pos - p + s >= lo AND pos - p + s + w <= n_words"
        " AND slice(near, pos - p + s - lo + 1, w) = slice(span, s - from + 1, w)), s -> struct(pos - p + s AS a, pos - p + s + w AS b))"
    )
    hit = place.join(rare, "h").select("rid", "item_id", starts.alias("m")).where("size(m) > 0").select("rid", "item_id", F.array_min("m.a").alias("a"), F.array_max("m.b").alias("b"))
    before = Window.partitionBy("rid").orderBy("a", "b", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(before), F.lit(0))))
    hits = hit.withColumn("fresh", fresh).groupBy("rid").agg(F.sum("fresh").alias("n_hit"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    items = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    return found.where("own").select("rid", "doc_id", "n_words").join(hits, "rid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "rid",
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no window; rows that share an id, or have none, are judged one by one."""
    rows, number = numbered(documents)
    hit = decontaminate(rows.select(F.col(number).alias("doc_id"), "text"), benchmark).where("contaminated").select(F.col("doc_id").alias(number))
    return rows.join(hit, number, "left_anti").select(*documents.columns)
