"""Operator 11: k-means with centroids of integers, rounds run over ball trees.

A task packs the vectors of its partition into blocks and builds a metric tree over each, once: every node
keeps radius, count and integer sum of its vectors. A round sends each tree's nodes down by the triangle inequality: where
one centroid is nearer than any other to all of a ball, the ball's count and sum go to it whole;
otherwise centroids that can't be nearest are left out and the children are asked; leaves compare exactly.
Copies of a vector are a ball of radius 0, so a hot vector is one node. A task adds its trees up, so each
sends k rows of counts and sums, and the driver sees k rows a round, whatever the input's size.

Components are integers up to ``LIMIT`` in size, which keeps squared distances in a long; a larger one is an error that says so.
Distances are whole numbers everywhere: in doubles where they stay below 2**53, else in longs. Bounds are taken with slack, so
rounding may only send a ball further down.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left out; ties go to the
smaller centroid; rows that repeat an id are vectors of their own, a null id is kept (its hash is that of ``3:null``); equal hashes are ordered by the vectors;
with fewer vectors than centroids there are as many centroids as vectors; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspring.llm.common import passing_tables, written

DIMS, K, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Vectors of one tree and of one leaf.
BLOCK, LEAF = 4096, 32
#: Largest size of a component, and the largest with which products stay whole in doubles.
LIMIT, EXACT = 1 << 27, 1 << 22
SLACK = 1e-9


def kept_vectors(df: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: integer vectors of the rows that take part."""
    e = F.col("embedding")
    good = (F.size(e) == dims) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def tree(vectors: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order that puts each node's vectors in a row, and the nodes: start, end, left (0: a leaf; the right child follows it), sums, radius."""
    order = np.arange(len(vectors))
    at, nodes = 0, [(0, len(vectors))]
    left, sums, radius = [], [], []
    floats = vectors.astype(np.float64)
    while at < len(nodes):
        a, b = nodes[at]
        mine = order[a:b]
        x = floats[mine]
        total = vectors[mine].sum(axis=0)
        centre = total / (b - a)
        far = np.sqrt(((x - centre) ** 2).sum(axis=1))
        sums.append(total)
        radius.append(far.max() * (1 + SLACK) + SLACK)
        if b - a <= LEAF or (x == x[0]).all():
            left.append(0)
        else:
            one = x[far.argmax()]
            other = x[((x - one) ** 2).sum(axis=1).argmax()]
            by = np.argsort(x @ (other - one), kind="stable")
            order[a:b] = mine[by]
            left.append(len(nodes))
            nodes += [(a, (a + b) // 2), ((a + b) // 2, b)]
        at += 1
    ends = np.array(nodes, np.int64)
    return order, {"start": ends[:, 0], "end": ends[:, 1], "left": np.array(left, np.int64), "sums": np.array(sums, np.int64), "radius": np.array(radius)}


_TREE = "vec_id array<long>, vectors binary, start binary, end binary, left binary, sums binary, radius binary"
_NAMES = [c.split()[0] for c in _TREE.split(", ")]


def forest(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """Rows of one tree each, made where the vectors are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            x = np.concatenate(held)
            if np.abs(x).max() > LIMIT:
                raise ValueError(f"a component exceeds {LIMIT}: squared distances would not fit a long")
            order, nodes = tree(x)
            columns = [pa.array([[ids[i] for i in order.tolist()]], pa.list_(pa.int64())), pa.array([x[order].tobytes()])]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([nodes[n].tobytes()]) for n in _NAMES[2:])], _NAMES)

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids += part.column(0).to_pylist()
                held.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                if len(ids) >= BLOCK:
                    yield out()
                    ids, held = [], []
        if ids:
            yield out()

    return vectors.mapInArrow(run, _TREE)


def _opened(row: dict, dims: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    whole = {n: np.frombuffer(row[n], np.float64 if n == "radius" else np.int64) for n in _NAMES[1:]}
    whole["sums"] = whole["sums"].reshape(-1, dims)
    return whole.pop("vectors").reshape(-1, dims), whole


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each vector."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, b = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def descend(vectors: np.ndarray, nodes: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(centroid of each node taken whole, else -1) and the leaves' vectors with their centroids.

    A ball is taken whole if its farthest vector is nearer to one centroid than its nearest could be to any other; centroids
    out of reach are not looked at further down.
    """
    count = nodes["end"] - nodes["start"]
    whole = np.full(len(count), -1)
    leaves = []
    front, open_ = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    floats = centroids.astype(np.float64)
    while len(front):
        centre = nodes["sums"][front] / count[front][:, None]
        gap = np.sqrt(np.maximum(((centre[:, None, :] - floats) ** 2).sum(axis=2), 0))
        slack = gap * SLACK + SLACK
        gap_low, gap_high = gap - slack - nodes["radius"][front][:, None], gap + slack + nodes["radius"][front][:, None]
        bound = np.where(open_, gap_high, np.inf).min(axis=1)
        open_ = open_ & (gap_low <= bound[:, None])
        sure = open_.sum(axis=1) == 1
        whole[front[sure]] = open_[sure].argmax(axis=1)
        front, open_ = front[~sure], open_[~sure]
        last = nodes["left"][front] == 0
        if last.any():
            sizes = count[front[last]]
            at = np.repeat(nodes["start"][front[last]], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            far = np.where(np.repeat(open_[last], sizes, axis=0), squared(vectors[at], centroids), np.iinfo(np.int64).max)
            leaves.append((at, far.argmin(axis=1)))
        children = nodes["left"][front[~last]]
        front, open_ = np.concatenate((children, children + 1)), np.concatenate((open_[~last], open_[~last]))
    return whole, leaves


def sums_of_round(trees: DataFrame, centroids: list[list[int]], dims: int = DIMS) -> list:
    """cluster, n and the exact sum of each component of its vectors, for each cluster that has some."""
    names = ["cluster", "n", *[f"s{i}" for i in range(dims)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        n, total = np.zeros(len(c), np.int64), np.zeros((len(c), dims), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                vectors, nodes = _opened({k: batch.column(k)[i].as_py() for k in _NAMES[1:]}, dims)
                whole, leaves = descend(vectors, nodes, c)
                taken = np.flatnonzero(whole >= 0)
                np.add.at(n, whole[taken], (nodes["end"] - nodes["start"])[taken])
                np.add.at(total, whole[taken], nodes["sums"][taken])
                for at, to in leaves:
                    np.add.at(n, to, 1)
                    for k in np.unique(to):
                        total[k] += vectors[at[to == k]].sum(axis=0)
        told = np.flatnonzero(n)
        if len(told):
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.int32()), pa.array(n[told]), *(pa.array(total[told, i]) for i in range(dims))], names)

    rows = trees.select(*_NAMES[1:]).mapInArrow(run, ", ".join(["cluster int", *[f"{n} long" for n in names[1:]]]))
    return rows.groupBy("cluster").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()


def assigned(trees: DataFrame, centroids: list[list[int]], dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance (squared) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in _NAMES[1:]}
                vectors, nodes = _opened(row, dims)
                whole, leaves = descend(vectors, nodes, c)
                to = np.zeros(len(vectors), np.int32)
                for node in np.flatnonzero(whole >= 0).tolist():
                    to[nodes["start"][node] : nodes["end"][node]] = whole[node]
                for at, k in leaves:
                    to[at] = k
                far = np.empty(len(vectors), np.int64)
                for k in np.unique(to):
                    far[to == k] = squared(vectors[to == k], c[k : k + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(to), pa.array(far)], ["vec_id", "cluster", "distance"])

    return trees.select(*_NAMES).mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ids have the least hashes: k rows."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [list(r.v) for r in vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def centroid_clusters(df: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that takes part (columns vec_id, embedding)."""
    spark = df.sparkSession
    vectors = kept_vectors(df, dims, scale)
    with passing_tables(spark) as keep:
        trees = written(forest(vectors, dims))
        centroids = first_centroids(vectors, k, seed)
        if not centroids:
            return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        for _ in range(rounds):
            moved = list(centroids)
            for r in sums_of_round(trees, centroids, dims):
                moved[r.cluster] = [s // r.n for s in r[2:]]
            if moved == centroids:  # nothing moves any more
                break
            centroids = moved
        found = keep(written(assigned(trees, centroids, dims)))
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    total = sum(r.s for r in sums)
    told = [(r.cluster, r.s, total, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in sums]
    return found.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
