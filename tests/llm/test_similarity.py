import random
import re

import numpy as np

from marlspring.llm import similarity
from marlspring.llm.components import components
from marlspring.llm.similarity import BANDS, allowed, bitmap, bits_differ, jaccard_components, shingle_sets, signatures


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_matches_brute_force_on_odd_texts(documents, odd_texts):
    assert got(jaccard_components(documents)) == brute(list(enumerate(odd_texts)))


def test_clashing_columns_and_empty_table(clashing, empty, odd_texts):
    assert got(jaccard_components(clashing)) == brute(list(enumerate(odd_texts)))
    assert jaccard_components(empty).count() == 0


def test_chain_of_near_copies_is_one_component(spark):
    rng = random.Random(1)
    text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(text)))
        text[rng.randrange(120)] = f"v{k}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(jaccard_components(df)) == brute(rows)


SIZES = [*range(3, 40), 53, 54, 55, 160, 161, 162, 163, 500, 1500]


def test_linked_sets_always_share_a_signature():
    """The pigeonhole bound over random pairs of every size near the threshold."""
    rng = np.random.default_rng(3)
    few_cheap = np.where(rng.random(1 << 20) < 0.3, 1, rng.integers(100, 9000, 1 << 20)).astype(np.uint64)
    for size, counts in [(n, p) for n in SIZES for p in (rng.integers(1, 50, 1 << 20).astype(np.uint64), few_cheap, np.ones(1 << 20, np.uint64))]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            drop = rng.integers(0, size // 4 + 1)
            add = rng.integers(0, size // 3 + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            i = len(np.intersect1d(a, b))
            if 100 * i < 75 * (len(a) + len(b) - i) or i == len(a) == len(b):
                continue
            who, sig = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), counts)
            assert set(sig[who == 0]) & set(sig[who == 1]), (len(a), len(b), i)
            assert bits_differ(bitmap(a), bitmap(b)) <= len(a) + len(b) - 2 * i <= allowed(len(a), len(b))


def test_bands_and_sets():
    assert BANDS[:4] == [1, 6, 18, 54]
    h, at = shingle_sets([None, "", "a b c d e a b c d e", "A B"])
    assert np.diff(at).tolist() == [0, 0, 5, 1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (22, 21), (22, 20), (5, 5), (100, 101)] + [(200 + k, 201 + k) for k in range(30)]
    found = {r.key: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20, 100: 100, 101: 100} | {200 + k: 200 for k in range(31)}


def test_near_copies_over_many_blocks(spark, monkeypatch):
    """Copies of one base that are linked with few others, in groups of many small blocks."""
    monkeypatch.setattr(similarity, "BLOCK", 4)
    monkeypatch.setattr(similarity, "CROWD", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for k in range(120):
        text = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            text[rng.randrange(90)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute(rows)
    assert got(jaccard_components(df)) == expected
    monkeypatch.setattr(similarity, "NAMED", 1)
    monkeypatch.setattr(similarity, "ROUNDS", ("nearest",))
    assert got(jaccard_components(df)) == expected


def test_members_are_compared_in_their_first_group_only(spark):
    """Of pairs that share two groups and lie in two components, each comes out once."""
    sets = {k: np.unique(np.random.default_rng(9).integers(0, 1 << 63, 60).astype(np.uint64)[k:]) for k in range(6)}
    known = spark.createDataFrame([(k, len(h), bytearray(bitmap(h))) for k, h in sets.items()], "key long, n long, bits binary")
    members = spark.createDataFrame([(g, k, k, 0) for g in (3, 7) for k in sets], "gid long, key long, root long, salt int")
    found = [(r.a, r.b) for r in similarity._cross_pairs(members, known).collect()]
    assert sorted(found) == [(a, b) for a in range(6) for b in range(a + 1, 6)]


def test_neighbourhoods_are_taken_where_whole_segments_are_dear():
    """A set that is mostly a common passage takes its own segments' neighbourhoods and so fewer signatures of the passage."""
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    slot = (h >> np.uint64(44)).astype(np.int64)
    dear = np.ones(1 << 20, np.uint64)
    dear[slot[rng.permutation(len(h))[:80]]] = 5000
    whole = similarity.DELETION
    try:
        similarity.DELETION = 4
        _, taken = signatures(h, np.array([0, len(h)]), dear)
        similarity.DELETION = 1 << 22  # never
        _, without = signatures(h, np.array([0, len(h)]), dear)
    finally:
        similarity.DELETION = whole
    assert len(set(taken) - set(without)) > 0 and len(set(without) - set(taken)) > 0
    _, plain = signatures(h, np.array([0, len(h)]), np.ones(1 << 20, np.uint64))
    assert set(plain) < set(without) | set(plain) and len(plain) <= 2 * (allowed(100, 133) + 1)


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(0, a), (1, a), (1, b), (2, b), (None, a), (None, None)]
    found = sorted((r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id IS NOT NULL").collect())
    assert found == [(0, 0), (1, 0), (1, 1), (2, 1)]


def test_long_groups_are_several_rows(monkeypatch):
    monkeypatch.setattr(similarity, "LONG", 3)
    sig, key = np.array([9] * 8 + [11] * 2, np.uint64), np.arange(10)
    out = similarity._emitted(sig, key, np.array([0, 8]), np.array([8, 2]), np.zeros(2, bool))
    assert max(map(len, out.column(1).to_pylist())) == 3 and sorted(sum(out.column(1).to_pylist(), [])) == list(range(10))
    assert {g for g, p in zip(out.column(0).to_pylist(), out.column(3).to_pylist()) if p} == {9}


def test_bitmap_of_wanted_keys_takes_no_job_for_each_partition(spark):
    """A job for each partition (toLocalIterator) took 16 of the 256 seconds of a run over 211 partitions, three times."""
    keys = [-(1 << 63), -1, 0, 1, 63, 64, similarity.WANTED - 1, similarity.WANTED, 5 * similarity.WANTED + 70, *range(10_000, 2_000_000, 4099)]
    sc, held = spark.sparkContext, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    tracker, before = sc.statusTracker(), {k: spark.conf.get(k) for k in held}
    df = spark.createDataFrame([(k,) for k in [*keys, *keys[:5]]], "key long").repartition(7)
    for k, v in held.items():
        spark.conf.set(k, v)
    sc.setJobGroup("bitmap", "bitmap")
    try:
        bits = similarity.wanted_bitmap(df)
        jobs = len(tracker.getJobIdsForGroup("bitmap"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    low = np.array(keys, np.int64).astype(np.uint64) & np.uint64(similarity.WANTED - 1)
    expected = np.zeros(similarity.WANTED // 64, np.uint64)
    np.bitwise_or.at(expected, (low >> np.uint64(6)).astype(np.int64), np.uint64(1) << (low & np.uint64(63)))
    assert (bits == expected).all()
    assert jobs <= 4
    assert not similarity.wanted_bitmap(df.limit(0)).any()


def test_components_of_repeated_edges_and_of_none(spark):
    edges = spark.createDataFrame([(5, 2), (2, 5), (5, 2), (2, 9), (7, 7), (-1, 30), (30, 31)], "a long, b long")
    assert {r.key: r.root for r in components(edges).collect()} == {2: 2, 5: 2, 9: 2, -1: -1, 30: -1, 31: -1}
    assert components(edges.limit(0)).count() == 0
