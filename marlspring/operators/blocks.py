"""Vectors against a stated query set, in blocks of bounded size, and order statistics without a sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Expected vectors and queries that one task multiplies at a time.
VECTORS, QUERIES = 4096, 1024
#: Queries whose scores a task holds at once.
ROWS = 128


def _chosen(scores: np.ndarray, ids: np.ndarray, k: int | None, least: int | None) -> np.ndarray:
    """Places of the k best scores (ties by id), or of all, among those of ``least`` or more."""
    bound = -(2**62) if least is None else least
    if k is not None and k < len(scores):
        bound = max(bound, np.partition(scores, len(scores) - k)[len(scores) - k])
    at = np.flatnonzero(scores >= bound)
    at = at[np.lexsort((ids[at], -scores[at]))]
    return at if k is None else at[:k]


def dense_blocks(vectors: DataFrame, queries: DataFrame, k: int | None = None, least: int | None = None) -> DataFrame:
    """qid, doc_id, score (cosine in millionths, half up) of vectors (doc_id, embedding) for queries (qid, embedding).

    Each block of queries meets each block of vectors in a task of its own, which gives out only its k best a query
    (or those from ``least`` millionths on); the caller ranks what the blocks gave. Blocks are dealt by hash, so no key
    makes one large. A query isn't its own hit; vectors that are null, hold nulls or non-finite numbers, or differ in
    length from a query don't meet it; a vector of zeros scores 0.
    """
    fit = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v, q = vectors.select("doc_id", "embedding").where(fit), queries.select("qid", "embedding").where(fit)
    blocks, asked = max(1, -(-v.count() // VECTORS)), max(1, -(-q.count() // QUERIES))
    meets = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.select("doc_id", "embedding", F.size("embedding").alias("_d"), F.expr(f"pmod(xxhash64(doc_id), {blocks})").cast("int").alias("_v"), meets(asked).alias("_q"))
    # A name of its own: both sides may be read from one table.
    q = q.select("qid", F.col("embedding").alias("asked"), F.size("embedding").alias("_d"), F.expr(f"pmod(xxhash64(qid), {asked})").cast("int").alias("_q"), meets(blocks).alias("_v"))

    def unit(column: pd.Series) -> np.ndarray:
        m = np.stack(column.to_numpy()).astype(float)
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            ids, held = left["doc_id"].to_numpy(), unit(left["embedding"])
            wanted, names = unit(right["asked"]), right["qid"].to_numpy()
            for begin in range(0, len(names), ROWS):
                scores = np.floor(wanted[begin : begin + ROWS] @ held.T * 1e6 + 0.5).astype(np.int64)
                for name, row in zip(names[begin : begin + ROWS], scores):
                    other = np.flatnonzero(ids != name)
                    at = other[_chosen(row[other], ids[other], k, least)]
                    out.append(pd.DataFrame({"qid": np.full(len(at), name), "doc_id": ids[at], "score": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "doc_id": [], "score": []}, dtype="int64")

    keys = ("_v", "_q", "_d")
    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(meet, "qid long, doc_id long, score long")


def _narrowed(values: DataFrame, n: int, bins: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, place) of the n-th smallest of the column ``x``, ever narrower."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    yield low, high, n
    while low < high:
        width = (high - low) // bins + 1
        counts = values.where(F.col("x").between(low, high)).groupBy(F.expr(f"(x - {low}L) div {width}L").alias("bin")).count().collect()  # bins rows at most
        for b, c in sorted(counts):
            if n <= c:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            n -= c
        yield low, high, n


def nth_smallest(values: DataFrame, name: str, n: int, bins: int = 1024) -> int | None:
    """The n-th smallest (from 1) of a column of whole numbers; null if it holds fewer. Nulls don't count.

    Every pass counts the rows of ``bins`` equal ranges and goes on in the one that holds the place: no sort, no task
    with more than its share, however many rows are equal, and log(span) / log(bins) passes. The span is under 2^63.
    """
    x = values.select(F.col(name).cast("long").alias("x")).where("x IS NOT NULL")
    if n < 1 or x.count() < n:
        return None
    for low, _, _ in _narrowed(x, n, bins):
        pass
    return low
