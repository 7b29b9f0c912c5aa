"""New records matched with existing ones by several signals: names, classes, places, origins and shared references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspring.functions.scalars import strip

SIGNALS = ("name", "class", "place", "origin")
LISTS = ("dois", "titles")
#: The signals' weights, and how the weight of a missing name or class is dealt to the others.
NAME, CLASS, PLACE, REFERENCES, ORIGIN = 0.5, 0.2, 0.15, 0.15, 0.05
TO_PLACE, TO_REFERENCES, TO_ORIGIN = 0.6, 0.3, 0.1
EPS = 1e-9
#: Existing records that meet a block of new ones at a time, by number and by length of names and lists; pairs whose names' counts
#: are compared at a time; counters of a name's pairs of characters and of its characters; values whose ratios are worked out beforehand.
ROWS, BLOCK, LENGTH, PAIRS, GRAMS, LETTERS, TABLE = 512, 1024, 1 << 20, 8192, 256, 64, 4096
#: What sums in single precision may be off.
OFF = 1e-5


def weights(name: Column, kind: Column) -> dict[str, Column]:
    """The signals' weights for a new record: what a missing name or class would have weighed goes to place, references, origin."""
    missing = lambda c: c.isin("", "unknown")
    w_name, w_class = F.when(missing(name), 0.0).otherwise(NAME), F.when(missing(kind), 0.0).otherwise(CLASS)
    rest = F.lit(NAME + CLASS) - (w_name + w_class)
    return {"name": w_name, "class": w_class, "place": PLACE + rest * TO_PLACE, "references": REFERENCES + rest * TO_REFERENCES, "origin": ORIGIN + rest * TO_ORIGIN}


def _clean(rows: DataFrame, key: str) -> DataFrame:
    """key, signals lower-cased, lists as sets of what isn't empty; rows without a key are left out."""
    text = lambda c: F.lower(strip(F.when(F.coalesce(F.col(c), F.lit("")) == "", "unknown").otherwise(F.col(c))))
    held = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(strip(x))), lambda x: x.isNotNull() & (x != "")))
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[text(c).alias(c) for c in SIGNALS], *[F.transform(held(c), lambda x: F.xxhash64(x)).alias(c) for c in LISTS])


def grams(name: str, t: float) -> list[tuple[int, str, int]]:
    """(kind, token, tokens to keep) of a name: any two names of ratio t or more share a token of one kind among those kept.

    Of L characters in both, M >= t * L / 2 match in at most 1 + L - 2 * M blocks, so 3 * M - 1 - L pairs of neighbouring
    characters are shared; partners whose length makes that none share characters instead. Repeats are numbered, so that
    sets stand for multisets. The least shared number over all lengths a partner may have says how many tokens may be left out.
    """
    n = len(name)
    partners = range(max(1, ceil(n * t / (2 - t) - EPS)), int(n * (2 - t) / t + EPS) + 1)
    matched = {m: ceil(t * (n + m) / 2 - EPS) for m in partners}
    pairs = [3 * k - 1 - n - m for m, k in matched.items() if 3 * k - 1 - n - m >= 1]
    singles = [k for m, k in matched.items() if 3 * k - 1 - n - m < 1]
    out = []
    for kind, shared in ((2, pairs), (1, singles)):
        if n >= kind and shared:
            seen: Counter[str] = Counter()
            keep = n - kind + 1 - min(shared) + 1
            for i in range(n - kind + 1):
                g = name[i : i + kind]
                seen[g] += 1
                out.append((kind, f"{g}{seen[g]}", keep))
    return out


@lru_cache(maxsize=16384)
def _remembered(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else _remembered(a, b) if len(a) + len(b) <= 256 else SequenceMatcher(None, a, b).ratio()


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most that ratios can be by the strings' lengths."""
    return np.where((a > 0) & (b > 0), 2.0 * np.minimum(a, b) / np.maximum(a + b, 1), 0.0)


def _sizes(values: list) -> np.ndarray:
    return np.array([len(v) for v in values], np.int64)


def _counts(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often hashes of neighbouring characters, and of characters, occur in each name; hashes that meet can only add to what names share."""
    of = np.repeat(np.arange(len(names)), _sizes(names))
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inside = of[1:] == of[:-1]
    pairs = ((codes[:-1] * 0x9E3779B1 + codes[1:] * 0x85EBCA6B) >> 12) % GRAMS
    count = lambda row, token, n: np.bincount(row * n + token, minlength=len(names) * n).reshape(-1, n).astype(np.int32)
    return count(of[1:][inside], pairs[inside], GRAMS), count(of, codes % LETTERS, LETTERS)


class _Table:
    """The ratios of some strings with others, or, where they are very many, what lengths allow."""

    def __init__(self, a: list[str], b: list[str]):
        left, right = list(dict.fromkeys(a)), list(dict.fromkeys(b))
        self.exact = len(left) * len(right) <= TABLE
        rows, cols = ({x: i for i, x in enumerate(v)} for v in (left, right))
        self.rows, self.cols = np.array([rows[x] for x in a]), np.array([cols[x] for x in b])
        # Rows are existing records, columns new ones; a ratio takes the new one first.
        self.values = np.array([[_ratio(y, x) for y in right] for x in left]) if self.exact else _lengths(_sizes(left)[:, None], _sizes(right)[None, :])

    def all(self) -> np.ndarray:
        return self.values.astype(np.float32)[:, self.cols][self.rows]

    def of(self, e: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.values[self.rows[e], self.cols[q]]


class _Sets:
    """Sets of values by value: who holds each."""

    def __init__(self, sets: list):
        self.sizes = _sizes(sets)
        flat, owner = np.concatenate([np.empty(0, np.int64), *[np.asarray(s, np.int64) for s in sets]]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.values, self.begin, self.n = np.unique(flat[order], return_index=True, return_counts=True)

    def overlap(self, other: _Sets) -> np.ndarray:
        """Jaccard similarities of the other's sets (rows) with these (columns)."""
        shape = (len(other.sizes), len(self.sizes))
        if not len(self.values) or not len(other.values):
            return np.zeros(shape)
        _, mine, its = np.intersect1d(self.values, other.values, assume_unique=True, return_indices=True)
        both = np.zeros(shape[0] * shape[1])
        for i, j in zip(mine, its):
            q, e = self.owner[self.begin[i] : self.begin[i] + self.n[i]], other.owner[other.begin[j] : other.begin[j] + other.n[j]]
            both[(e[:, None] * shape[1] + q).ravel()] += 1  # a set holds a value once, so no place is twice among these
        both = both.reshape(shape)
        return both / np.maximum(other.sizes[:, None] + self.sizes - both, 1)


class _Some:
    """Records as columns."""

    def __init__(self, rows: list[dict]):
        self.keys = [r["key"] for r in rows]
        self.texts = {c: [r[c] for r in rows] for c in SIGNALS}
        self.names, self.origins = np.array(self.texts["name"], object), np.array(self.texts["origin"], object)
        self.size, self.origin_size = _sizes(self.texts["name"]), _sizes(self.texts["origin"])
        self.grams, self.letters = _counts(self.texts["name"])
        self.sets = [_Sets([r[c] for r in rows]) for c in LISTS]


class _Asked(_Some):
    """A block of new records, their weights, and each one's two best existing keys so far."""

    def __init__(self, rows: list[dict], least: float):
        super().__init__(rows)
        self.least = least - EPS
        self.w = {n: np.array([r[f"w_{n}"] for r in rows]) for n in ("name", "class", "place", "references", "origin")}
        self.total = sum(self.w.values())
        self.light = {n: v.astype(np.float32) for n, v in self.w.items()}
        self.best: list[dict] = [{} for _ in rows]
        self.bound = np.full(len(rows), self.least)

    def meet(self, old: _Some) -> None:
        """Every pair is bounded by what is cheap to know, then by its names' characters and pairs of them; what may still be among the best is scored."""
        w, overlap = self.light, np.maximum.reduce([a.overlap(b) for a, b in zip(self.sets, old.sets)])
        tables = {c: _Table(old.texts[c], self.texts[c]) for c in ("class", "place")}
        most = overlap.astype(np.float32) * w["references"] + w["origin"] * ((old.origin_size > 0)[:, None] & (self.origin_size > 0))
        for c, t in tables.items():
            most += t.all() * w[c]
        most += _lengths(old.size.astype(np.float32)[:, None], self.size.astype(np.float32)) * w["name"]
        e, q = np.nonzero(most >= (self.bound * self.total - OFF).astype(np.float32))
        for i in range(0, len(e), PAIRS):
            self._score(old, e[i : i + PAIRS], q[i : i + PAIRS], overlap, tables)

    def _score(self, old: _Some, e: np.ndarray, q: np.ndarray, overlap: np.ndarray, tables: dict[str, _Table]) -> None:
        known = lambda: self.w["references"][q] * overlap[e, q] + sum(self.w[c][q] * t.of(e, q) for c, t in tables.items()) + self.w["origin"][q]
        ratio = np.divide(self.bound[q] * self.total[q] - known(), self.w["name"][q], out=np.zeros(len(e)), where=self.w["name"][q] > 0)
        length = old.size[e] + self.size[q]
        matched = np.ceil(ratio * length / 2 - OFF)
        near = np.flatnonzero(np.minimum(self.letters[q], old.letters[e]).sum(axis=1) >= matched)
        e, q, matched, length = e[near], q[near], matched[near], length[near]
        # Matched characters are in at most 1 + length - 2 * matched blocks, so 3 * matched - 1 - length pairs of neighbours are shared.
        near = np.flatnonzero(np.minimum(self.grams[q], old.grams[e]).sum(axis=1) >= 3 * matched - 1 - length)
        e, q = e[near], q[near]
        sims = {c: t.of(e, q) for c, t in tables.items()} | {"references": overlap[e, q]}
        for c, mine, its in (("name", self.names, old.names), ("origin", self.origins, old.origins)):
            sims[c] = ((mine[q] == its[e]) & (its[e] != "")).astype(float)
        rest = (sims["name"] == 0) | (sims["origin"] == 0) | (not all(t.exact for t in tables.values()))
        for i in np.flatnonzero(rest):
            a, b = q[i], e[i]
            for c in ("class", "place", "origin"):
                sims[c][i] = _ratio(self.texts[c][a], old.texts[c][b])
            least = (self.bound[a] * self.total[a] - sum(self.w[c][a] * sims[c][i] for c in self.w if c != "name")) - OFF
            sims["name"][i] = _ratio(self.names[a], old.names[b]) if self.w["name"][a] >= least else 0.0
        score = sum(self.w[c][q] * sims[c] for c in ("name", "class", "place", "references", "origin")) / self.total[q]
        held = np.flatnonzero((score >= self.least) & (score >= self.bound[q]))
        taken: dict[int, set] = {}
        for a, s, key in sorted(((int(q[i]), -score[i], old.keys[e[i]]) for i in held)):
            if len(taken.setdefault(a, set())) < 2:
                taken[a].add(key)
                self.best[a][key] = max(-s, self.best[a].get(key, 0.0))
        for a in taken:
            two = sorted(self.best[a].items(), key=lambda x: (-x[1], x[0]))[:2]
            self.best[a] = dict(two)
            if len(two) == 2:
                self.bound[a] = two[1][1]


def _chunks(batch: pa.RecordBatch) -> Iterator[_Some]:
    """A batch in parts, bounded by records and by the length of their names and lists."""
    rows, length = [], 0
    for i in range(batch.num_rows):
        r = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
        rows.append(r)
        length += len(r["name"]) + sum(len(r[c]) for c in LISTS)
        if len(rows) == ROWS or length > LENGTH:
            yield _Some(rows)
            rows, length = [], 0
    if rows:
        yield _Some(rows)


def record_matches(new: DataFrame, existing: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """new_key, old_key, score: the existing record most like each new one, at ``least`` (within 1e-9) or over; ties by the least key.

    Records hold a key, ``SIGNALS`` as strings and ``LISTS`` as arrays of strings. The score is the weighted mean of the
    strings' ratios (twice the matching characters over all) and of the larger Jaccard similarity of the two lists; weights
    of a missing name or class go to the others.

    Every existing record meets every new one inside the task that reads it, blocks at a time. A pair is left as soon as what is known of it
    can't reach the bound, or the two best of the new record so far; no pair leaves a task but these, so nothing that grows with pairs is
    shuffled, held or written. New records are the stated side: their distinct names and the hashes of their lists are sent to all tasks.
    Values of lists are compared by 64-bit hashes.

    Defined results: null and empty strings are "unknown" and equal each other; a string of white space only is like
    nothing; null lists are empty, and share nothing; entries that are null or blank don't count; rows without a key are
    left out, repeated rows count once, and of several records under one key the best pair counts; a record isn't its own match, but a copy of it under another key is; new records
    without a match have no row; extra columns are ignored. A bound under 0.8 is refused, as the survey's own is 0.8.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("the bound must be from 0.8 to 1")
    lists = [F.array_sort(c).alias(c) for c in LISTS]
    rows = _clean(new, key).select("key", *SIGNALS, *lists).withColumn("cid", F.sha2(F.to_json(F.struct(*SIGNALS, *LISTS)), 256)).dropDuplicates(["cid", "key"])
    w = weights(F.col("name"), F.col("class"))
    distinct = rows.dropDuplicates(["cid"]).select(F.col("cid").alias("key"), *SIGNALS, *LISTS, *[F.lit(x).alias(f"w_{n}") if isinstance(x, float) else x.alias(f"w_{n}") for n, x in w.items()])
    asked = [r.asDict() for r in distinct.collect()]
    old = _clean(existing, key)
    kind = old.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_Asked(asked[i : i + BLOCK], least) for i in range(0, len(asked), BLOCK)]
        of = None
        for batch in batches:
            of = batch.schema.field("key").type
            for some in _chunks(batch):
                for b in blocks:
                    b.meet(some)
        if of is not None:
            found = [(b.keys[i], k, s) for b in blocks for i, two in enumerate(b.best) for k, s in two.items()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], of), pa.array([f[2] for f in found], pa.float64())], ["new", "old_key", "score"])

    schema = T.StructType([T.StructField("new", T.StringType()), T.StructField("old_key", kind), T.StructField("score", T.DoubleType())])
    found = old.mapInArrow(run, schema).groupBy("new", "old_key").agg(F.max("score").alias("score"))
    # At most the two best keys of a distinct record are needed: the best one may be the new record itself.
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("new").orderBy(F.desc("score"), "old_key"))).where("_r <= 2")
    met = rows.select(F.col("cid").alias("new"), F.col("key").alias("new_key")).join(best, "new").where("new_key <> old_key")
    return met.groupBy("new_key").agg(F.min_by(F.struct("old_key", "score"), F.struct(-F.col("score"), "old_key")).alias("m")).select("new_key", "m.old_key", "m.score")
