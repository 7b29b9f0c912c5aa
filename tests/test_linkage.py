"""Record matches against every pair scored directly."""

from difflib import SequenceMatcher
import random

import pytest

from marlspring.operators import linkage as K
from marlspring.plans import linkage

SCHEMA = "k long, name string, class string, place string, origin string, dois array<string>, titles array<string>, score int"


def like(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def score(a, b):
    """By the words of the operator's contract, without any of its code."""
    names = [x or "unknown" for x in a[1:5]]
    others = [x or "unknown" for x in b[1:5]]
    sets = [[{y.strip().lower() for y in (x or []) if y and y.strip()} for x in r[5:7]] for r in (a, b)]
    shared = max(len(x & y) / len(x | y) if x and y else 0.0 for x, y in zip(*sets))
    missing = [x.strip().lower() in ("", "unknown") for x in names]
    w = [0.0 if missing[0] else 0.5, 0.0 if missing[1] else 0.2]
    rest = 0.7 - sum(w)
    w += [0.15 + rest * 0.6, 0.05 + rest * 0.1, 0.15 + rest * 0.3]
    return sum(x * y for x, y in zip(w, [like(x, y) for x, y in zip(names, others)] + [shared])) / sum(w)


def best(new, old, least=0.8):
    out = {}
    for a in new:
        for b in old:
            s = score(a, b)
            if a[0] is not None and b[0] is not None and a[0] != b[0] and s >= least - 1e-12:
                out[a[0]] = min(out.get(a[0], (0.0, 0)), (-round(s, 6), b[0]))
    return {k: (b, -s) for k, (s, b) in out.items()}


def records(seed, n, first=0):
    r = random.Random(seed)
    change = lambda s: "".join(c if r.random() > 0.06 else r.choice("abcxyz ") for c in s)
    stems = ["northwest find 123", "allende", "murchison fall of 1969", "orgueil", "a", "", "ab", None, "Unknown", "  ", "long name " * 9]
    for k in range(first, first + n):
        refs = [r.sample(["10.1/a", "10.1/b", "10.1/c", " 10.1/A", "", None, "10.1/d"], r.randint(0, 4)) if r.random() < 0.8 else None for _ in range(2)]
        s = r.choice(stems)
        yield (k, change(s) if s else s, r.choice(["cm2", "CM2", "cv3", "unknown", None, "h5"]), r.choice(["antarctica", "chile", "Chile", None]), r.choice(["main belt", "mars", "", None]), *refs, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_are_those_of_all_pairs(spark, seed):
    new, old = list(records(seed, 70)), list(records(seed + 10, 150, 50))
    found = K.record_matches(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(old, SCHEMA), "k").collect()
    want = best(new, old)
    assert len(want) > 10
    assert {r.new_key: (r.old_key, round(r.score, 6)) for r in found} == want


def test_own_rows_copies_ties_and_missing_keys(spark):
    row = ("n", "c", "p", "o", ["x"], None, 0)
    rows = [(3, *row), (1, *row), (1, *row), (2, *row), (None, *row), (9, "other", "d", "q", "z", None, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.new_key: (r.old_key, r.score) for r in K.record_matches(df, df, "k").collect()} == {1: (2, 1.0), 2: (1, 1.0), 3: (1, 1.0)}
    empty = df.limit(0)
    assert K.record_matches(empty, df, "k").count() == K.record_matches(df, empty, "k").count() == 0
    with pytest.raises(ValueError):
        K.record_matches(df, df, "k", 0.7)


def test_grams_of_like_names_meet():
    r = random.Random(5)
    for t in (0.55, 0.7, 0.8, 0.95):
        names = ["".join(r.choice("abcd") for _ in range(r.randint(1, 14))) for _ in range(120)]
        order = {}
        for x in names:
            for kind, token, _ in K.grams(x, t):
                order[kind, token] = order.get((kind, token), 0) + 1
        kept = [{(k, g) for kind in (1, 2) for k, g, keep in sorted((x for x in K.grams(n, t) if x[0] == kind), key=lambda x: (order[x[:2]], x[1]))[: max([x[2] for x in K.grams(n, t) if x[0] == kind], default=0)]} for n in names]
        for a, x in zip(names, kept):
            for b, y in zip(names, kept):
                assert SequenceMatcher(None, a, b).ratio() < t or x & y, (a, b, t)


def test_query_takes_all_documents(spark, tmp_path):
    r = random.Random(8)
    words = "red blue small ring bolt gear iron stone".split()
    texts = {k: " ".join(r.choice(words) for _ in range(6)) + ". " + "\n".join(r.choice(words) for _ in range(3)) for k in range(230)}
    texts |= {400: texts[7], 500: texts[8].replace("red", "rod"), 600: None, 700: ""}
    rows = [(k, t, "en", f"s{k % 2}") for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    old = []
    for k, t, lang, source in rows:
        t = t or ""
        old.append((k, t.replace("\n", ".").split(".")[0], source, lang, t.split("\n")[0].split(" ")[0], [], t.split("\n")))
    want = best([x for x in old if x[0] % 100 == 0], old)
    assert {400, 500} <= want.keys() and 600 not in want  # texts without lines refer to nothing
    assert {x.new_key: (x.old_key, x.score) for x in linkage.record_matches(spark, str(tmp_path)).collect()} == {k: (b, round(s * 1e6)) for k, (b, s) in want.items()}


def test_two_records_of_one_key_hide_no_other_match(spark):
    """Of the two best pairs kept, both were the record's own once its key had a second record."""
    rows = [(1, "northwest find", "c", "p", "o", ["x"], None, 0), (1, "northwest finds", "c", "p", "o", ["x"], None, 0), (2, "northwest fin", "c", "p", "o", ["y"], None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.new_key: r.old_key for r in K.record_matches(df, df, "k").collect()} == {1: 2, 2: 1} == {k: b for k, (b, _) in best(rows, rows).items()}


def test_pairs_stay_in_the_task_that_reads_them(spark):
    """What leaves the tasks is two rows a new record at most; pairs that shared a gram were joined and shuffled before."""
    rows = [(k, "the and of " + "".join(random.Random(k).sample("the and of ring", 15)), f"c{k % 3}", "p", "o", [], [], 0) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1).localCheckpoint()
    group = "pairs-stay"
    spark.sparkContext.setJobGroup(group, group)
    found = K.record_matches(df.where("k % 10 = 0"), df, "k")
    assert found.count() <= 30
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if tracker.getStageInfo(s)) <= 60


@pytest.mark.parametrize("rows,block,pairs", [(512, 1024, 8192), (7, 5, 3)])
def test_bounds_lose_no_match(rows, block, pairs, monkeypatch):
    for name, value in (("ROWS", rows), ("BLOCK", block), ("PAIRS", pairs), ("TABLE", 4096 if rows > 7 else 1)):
        monkeypatch.setattr(K, name, value)
    r = random.Random(9)
    clean = lambda x, k: {"key": k} | {c: (v or "unknown").strip().lower() for c, v in zip(K.SIGNALS, x[1:5])} | {c: sorted({hash(y.strip().lower()) for y in v or [] if y and y.strip()}) for c, v in zip(K.LISTS, x[5:7])}
    old = list(records(21, 200)) + [(300 + i, r.choice("ab") * r.randint(150, 260) + "é\U0001f600 x" * i, "cm2", "chile", "mars", ["10.1/a"], [], 1) for i in range(12)]
    new = [x for x in old if x[0] % 5 == 0]
    asked = []
    for x in new:
        missing = [(x[i] or "unknown").strip().lower() in ("", "unknown") for i in (1, 2)]
        w = [0.0 if missing[0] else 0.5, 0.0 if missing[1] else 0.2]
        rest = 0.7 - sum(w)
        asked.append(clean(x, str(x[0])) | dict(zip(("w_name", "w_class", "w_place", "w_references", "w_origin"), (*w, 0.15 + rest * 0.6, 0.15 + rest * 0.3, 0.05 + rest * 0.1))))
    blocks = [K._Asked(asked[i : i + block], 0.8) for i in range(0, len(asked), block)]
    held = [clean(x, x[0]) for x in old]
    for i in range(0, len(held), rows):
        for b in blocks:
            b.meet(K._Some(held[i : i + rows]))
    got = {}
    for b in blocks:
        for key, two in zip(b.keys, b.best):
            others = [(-round(s, 6), k) for k, s in two.items() if k != int(key)]
            if others:
                got[int(key)] = (min(others)[1], -min(others)[0])
    want = best(new, old)
    assert len(want) > 10 and got == want
