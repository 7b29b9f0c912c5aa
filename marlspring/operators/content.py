"""Recommendation by content: items whose features fit a user's preferences, above a threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspring.session import written

#: Expected users and kinds that meet in one task, and users whose similarities it holds at once.
USERS, KINDS, ROWS = 8192, 16_384, 32


def fit(preferences: Column, features: Column) -> Column:
    """The mean of preference times value over the features both maps hold, weighted by the preference's size; 0 without any."""
    shared = F.filter(F.map_entries(preferences), lambda e: F.map_contains_key(features, e["key"]))
    top = F.aggregate(shared, F.lit(0.0), lambda s, e: s + e["value"] * features[e["key"]] * F.abs(e["value"]))
    weight = F.aggregate(shared, F.lit(0.0), lambda s, e: s + F.abs(e["value"]))
    return F.when(weight > 0, top / weight).otherwise(F.lit(0.0))


def _held(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One list of (feature, value) a key, by feature; of rows that repeat a feature the largest value counts."""
    one = rows.where(F.col("feature").isNotNull() & F.col(value).isNotNull()).groupBy(key, "feature").agg(F.max(value).cast("double").alias(value))
    return one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature", value))).alias(name))


def _as_map(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One map a key; of rows that repeat a feature the largest value counts."""
    return _held(rows, key, value, name).select(key, F.map_from_entries(name).alias(name))


def content_matches(preferences: DataFrame, items: DataFrame, seen: DataFrame | None = None, threshold: float = 0.3, salts: int = 16) -> DataFrame:
    """user, item, similarity (over the threshold) of items that a user has not seen.

    preferences (user, feature, weight), items (item, feature, value), seen (user, item). A weighted mean is over the threshold only
    if some shared feature's product is, so only such (user, feature, item) are joined, on an index by feature from which rows that no
    partner can lift over the threshold are left out by each feature's extremes. Pairs found are compared exactly once. A
    feature that very many have is dealt over ``salts`` tasks. A map holds one user's or item's features, so its size is their number.

    Defined results: null features, weights and values count as absent; of repeated rows the largest value counts; a threshold under 0
    is refused, as pairs without a shared feature would pass it; empty tables give no rows; extra columns are ignored.
    """
    if threshold < 0:
        raise ValueError("the threshold must be 0 or more")
    bound = threshold - 1e-9  # a mean may be rounded over the threshold
    likes, has = _as_map(preferences, "user", "weight", "likes"), _as_map(items, "item", "value", "has")
    p = likes.select("user", F.explode("likes").alias("feature", "w"))
    i = has.select("item", F.explode("has").alias("feature", "v"))
    w_ends = p.groupBy("feature").agg(F.min("w").alias("w0"), F.max("w").alias("w1"))
    v_ends = i.groupBy("feature").agg(F.min("v").alias("v0"), F.max("v").alias("v1"))
    p = p.join(v_ends, "feature").where(F.greatest(F.col("w") * F.col("v0"), F.col("w") * F.col("v1")) > bound).select("user", "feature", "w")
    i = i.join(w_ends, "feature").where(F.greatest(F.col("v") * F.col("w0"), F.col("v") * F.col("w1")) > bound).select("item", "feature", "v")
    p = p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    i = i.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)).cast("int"))
    pairs = p.join(i, ["feature", "salt"]).where(F.col("w") * F.col("v") > bound).select("user", "item").distinct()
    fresh = pairs if seen is None else pairs.join(seen.select("user", "item").distinct(), ["user", "item"], "left_anti")
    scored = fresh.join(likes, "user").join(has, "item").select("user", "item", fit(F.col("likes"), F.col("has")).alias("similarity"))
    return scored.where(F.col("similarity") > threshold)


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row that each element of a column of lists is in, and the elements."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_parent_indices(whole).to_numpy(zero_copy_only=False), pc.list_flatten(whole)


class _Block:
    """Some kinds, in order; their features lie by number in rows of ``feature`` and ``value``, filled up with one that nobody likes."""

    def __init__(self, kinds: pa.Table):
        kinds = kinds.sort_by("kind")
        self.kinds, self.n, self.items = (kinds.column(c).to_numpy() for c in ("kind", "n", "items"))
        row, has = _lists(kinds.column("has"))
        self.names = pc.unique(pc.struct_field(has, "feature"))
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.feature = np.full((place.max() + 1, len(self.kinds)), len(self.names))
        self.value = np.zeros(self.feature.shape)
        self.feature[place, row] = pc.index_in(pc.struct_field(has, "feature"), self.names).to_numpy()
        self.value[place, row] = pc.struct_field(has, "value").to_numpy()
        if "least" in kinds.column_names:
            row, self.least = _lists(kinds.column("least"))
            self.least, self.begins = self.least.to_numpy(), np.searchsorted(row, np.arange(len(self.kinds) + 1))

    def similarities(self, weights: np.ndarray) -> np.ndarray:
        """As ``fit``, of each kind (row) for each user (column of the weights by feature)."""
        top, weight = np.zeros((len(self.kinds), weights.shape[1])), np.zeros((len(self.kinds), weights.shape[1]))
        for feature, value in zip(self.feature, self.value):
            w = weights[feature]
            size = np.abs(w)
            w *= value[:, None]
            w *= size
            top += w
            weight += size
        return np.divide(top, weight, out=np.zeros_like(top), where=weight > 0)

    def least_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in ``at`` and the number of the least items of those kinds."""
        many = self.begins[at + 1] - self.begins[at]
        place = np.repeat(np.arange(len(at)), many)
        return place, self.least[np.arange(many.sum()) + (self.begins[at] - many.cumsum() + many)[place]]


def _met(users: pa.Table, block: _Block, threshold: float) -> Iterator[tuple]:
    """For some users at a time: the first one's place, similarities of kinds by users, which match, kinds' and users' places and items
    of those that match and are seen, and how many matches are not, with the sum of their items."""
    (row, feature), (_, weight) = _lists(users.column("feature")), _lists(users.column("weight"))
    number = pc.index_in(feature, block.names)
    known = number.is_valid().to_numpy(zero_copy_only=False)
    row, number, weight = row[known], number.drop_null().to_numpy(), weight.to_numpy()[known]
    (who, kind), (_, item) = _lists(users.column("kind")), _lists(users.column("item"))
    kind, item = kind.to_numpy(), item.to_numpy()
    at = np.minimum(np.searchsorted(block.kinds, kind), len(block.kinds) - 1)
    here = block.kinds[at] == kind
    at, who, item = at[here], who[here], item[here]
    for begin in range(0, users.num_rows, ROWS):
        end = min(begin + ROWS, users.num_rows)
        weights = np.zeros((len(block.names) + 1, end - begin))
        part = slice(*np.searchsorted(row, [begin, end]))
        weights[number[part], row[part] - begin] = weight[part]
        similar = block.similarities(weights)
        match = similar > threshold
        part = slice(*np.searchsorted(who, [begin, end]))
        k, u, i = at[part], who[part] - begin, item[part]
        hit = match[k, u]
        k, u, i = k[hit], u[hit], i[hit]
        n, items = block.n @ match, block.items @ match
        np.subtract.at(n, u, 1)
        np.subtract.at(items, u, i)
        yield begin, similar, match, k, u, i, n, items


def _most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, m: the most items of a kind that one of a batch's users has seen."""
    for batch in batches:
        row, kind = _lists(batch.column("kind"))
        if not len(row):
            continue
        pairs, times = np.unique(np.stack([kind.to_numpy(), row]), axis=1, return_counts=True)
        kinds, at = np.unique(pairs[0], return_inverse=True)
        m = np.zeros(len(kinds), np.int64)
        np.maximum.at(m, at, times)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(m)], ["kind", "m"])


def _rows(users: pa.Table, at: list[np.ndarray], **columns: list[np.ndarray]) -> pa.Table:
    """Long columns for the users at some places."""
    join = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
    return pa.table({"user": users.column("user").take(pa.array(join(at))), **{name: pa.array(join(c)) for name, c in columns.items()}})


class Kinds:
    """Matches between users and kinds (items of equal features): a kind is compared once a user, and no pair of them leaves a task.

    Blocks of ``USERS`` users meet blocks of ``KINDS`` kinds, each two in a task of their own, which says of a user how many items match and
    are unseen, and which are best. So memory is bounded by the blocks, one user's features and seen items, and what is
    shuffled grows with users and kinds; the work grows with their product. Users hold their features and what they have
    seen by kind; kinds are named by their least item. Users, and kinds, are written as tables, since their numbers are asked for first.

    Items are whole numbers. Seen items that have no feature don't matter; a seen item counts once.
    """

    def __init__(self, preferences: DataFrame, items: DataFrame, seen: DataFrame, threshold: float = 0.3):
        if threshold < 0:
            raise ValueError("the threshold must be 0 or more")
        self.threshold = threshold
        keyed = _held(items.repartition("item"), "item", "value", "has").select("item", F.sha2(F.to_json("has"), 256).alias("_key"), "has")
        self.kinds = written(keyed.groupBy("_key").agg(F.min("item").alias("kind"), F.count("*").alias("n"), F.sum("item").alias("items"), F.first("has").alias("has")))
        self.items = keyed.select("item", "_key").join(self.kinds.select("_key", "kind"), "_key").select("item", "kind")
        # Once by user; what follows is grouped where it lies.
        met = seen.select("user", "item").join(self.items, "item").select("user", "item", "kind").repartition("user")
        met = met.groupBy("user").agg(F.array_sort(F.collect_set(F.struct("kind", "item"))).alias("seen"))
        self.users = written(_held(preferences, "user", "weight", "likes").join(met, "user", "left").select("user", "likes.feature", "likes.weight", "seen.kind", "seen.item"))
        preferences.sparkSession._jvm.System.gc()  # what was shuffled to here is dropped from the disks

    @property
    def found(self) -> DataFrame:
        """liking, kind, similarity of each set of users' features and each kind that match: for looking at small tables."""
        likes = self.users.select(F.arrays_zip("feature", "weight").alias("likes")).select(F.sha2(F.to_json("likes"), 256).alias("user"), "likes")
        likes, has = likes.dropDuplicates(["user"]).select("user", F.inline("likes")), self.kinds.select(F.col("kind").alias("item"), F.inline("has"))
        return content_matches(likes, has, None, self.threshold).withColumnsRenamed({"user": "liking", "item": "kind"})

    def meet(self, kinds: DataFrame, give: Callable[[pa.Table, _Block], pa.Table], schema: str) -> DataFrame:
        """What ``give`` makes of each block of users and each of kinds."""
        parts, blocks = max(1, -(-self.users.count() // USERS)), max(1, -(-kinds.count() // KINDS))
        dealt = lambda key, n: F.expr(f"pmod(xxhash64({key}), {n})").cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        u = self.users.withColumn("_part", dealt("user", parts)).withColumn("_block", each(blocks))
        k = kinds.withColumn("_part", each(parts)).withColumn("_block", dealt("kind", blocks))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return give(left, _Block(right)) if left.num_rows and right.num_rows else give(left, None)

        return u.groupBy("_part", "_block").cogroup(k.groupBy("_part", "_block")).applyInArrow(run, schema)


def match_counts(kinds: Kinds) -> DataFrame:
    """user, n, items: the number of matches each user hasn't seen, and the sum of their (whole) numbers; users without one are left out."""
    threshold = kinds.threshold

    def give(users: pa.Table, block: _Block | None) -> pa.Table:
        at, n, items = [], [], []
        for begin, *_, many, total in _met(users, block, threshold) if block else ():
            at.append(begin + np.flatnonzero(many))
            n.append(many[many > 0])
            items.append(total[many > 0])
        return _rows(users, at, n=n, items=items)

    found = kinds.meet(kinds.kinds.select("kind", "n", "items", "has"), give, "user long, n long, items long")
    return found.groupBy("user").agg(F.sum("n").alias("n"), F.sum("items").alias("items"))


def best_of_kinds(kinds: Kinds, seen: DataFrame | None = None, k: int = 10, salts: int = 16) -> DataFrame:
    """The k best items of each user, as ``best_matches`` gives them, from kinds; ``seen`` is that of the kinds, which hold it already.

    Where no user has seen more than m items of a kind, its least k + m hold the k least that any has not seen, so a kind gives those. Of
    a user's kinds those count that have an unseen item and are among the k best of such, or tie with the last. A large
    kind is ranked in ``salts`` parts first.
    """
    most = kinds.users.select("kind").where("kind IS NOT NULL").mapInArrow(_most, "kind long, m long").groupBy("kind").agg(F.max("m").alias("m"))
    need = kinds.kinds.select("kind").join(most, "kind", "left").select("kind", (F.lit(k) + F.coalesce("m", F.lit(0))).alias("need"))
    least = kinds.items.join(need, "kind").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    for part in (["kind", "salt"], ["kind"]):
        least = least.withColumn("nth", F.row_number().over(Window.partitionBy(*part).orderBy("item"))).where("nth <= need")
    least = least.groupBy("kind").agg(F.collect_list("item").alias("least"))
    threshold = kinds.threshold

    def best(s6: np.ndarray, block: _Block, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(s6 >= 0)
        if len(at) > k:
            at = at[s6[at] >= np.partition(s6[at], len(at) - k)[len(at) - k]]
        place, item = block.least_of(at)
        if len(known):
            fresh = ~np.isin(item, known)
            place, item = place[fresh], item[fresh]
        score = s6[at][place]
        first = np.lexsort((item, -score))[:k]
        return item[first], score[first]

    def give(users: pa.Table, block: _Block | None) -> pa.Table:
        at, item, similarity, n = [], [], [], []
        for begin, similar, match, kind, who, known, many, _ in _met(users, block, threshold) if block else ():
            s6 = np.where(match, np.floor(similar * 1_000_000 + 0.5), -1).astype(np.int64)
            pair, times = np.unique(kind * len(many) + who, return_counts=True)
            all_ = pair[times == block.n[pair // len(many)]]  # kinds that a user has seen the whole of
            s6[all_ // len(many), all_ % len(many)] = -1
            s6 = np.ascontiguousarray(s6.T)
            ends = np.searchsorted(who, np.arange(len(many) + 1))
            for j in np.flatnonzero(many):
                items, scores = best(s6[j], block, known[ends[j] : ends[j + 1]])
                at.append(np.full(len(items), begin + j))
                item.append(items)
                similarity.append(scores)
                n.append(np.where(np.arange(len(items)) == 0, many[j], 0))  # a user's number once a block
        return _rows(users, at, item=item, similarity=similarity, n=n)

    found = kinds.meet(kinds.kinds.select("kind", "n", "items", "has").join(least, "kind"), give, "user long, item long, similarity long, n long")
    w = Window.partitionBy("user")
    ranked = found.withColumn("n", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("similarity"), "item")))
    return ranked.where(F.col("rank") <= k).select("user", "item", "similarity", F.col("rank").cast("long").alias("rank"), "n")


def best_matches(matches: DataFrame, k: int = 10) -> DataFrame:
    """The k best items of each user, with their rank and the number of its matches; ties by the item."""
    w = Window.partitionBy("user")
    ranked = matches.withColumn("s6", F.floor(F.col("similarity") * 1_000_000 + 0.5).cast("long"))
    ranked = ranked.withColumn("rank", F.row_number().over(w.orderBy(F.desc("s6"), "item"))).where(F.col("rank") <= k)
    counts = matches.groupBy("user").agg(F.count("*").alias("n"))
    return ranked.join(counts, "user").select("user", "item", F.col("s6").alias("similarity"), F.col("rank").cast("long").alias("rank"), "n")
