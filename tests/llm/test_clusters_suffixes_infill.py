import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspring.llm import suffixes
from marlspring.llm.clusters import EXACT, centroid_clusters, descend, first_centroids, kept_vectors, squared, tree
from marlspring.llm.infill import GRAMMARS, fill_in_middle, infill_digests, units
from marlspring.llm.suffixes import suffix_dedup, window_names

# ---- clustering


def brute_clusters(rows, k=8, rounds=10, seed=3, dims=64, scale=1024):
    kept = [(i, tuple(int(np.floor(float(x) * scale)) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        to = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), t in zip(kept, to) if t == j]
            if mine:
                cs[j] = tuple(sum(x) // len(mine) for x in zip(*mine))
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = Counter()
    for _, c, d in found:
        total[c] += d
    return Counter((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in found)


def got_clusters(df, **a):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroid_clusters(df, **a).collect())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def test_clusters_match_brute_force(spark):
    rng = random.Random(2)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(rng.gauss(i % 5, 0.3)) for _ in range(64)]) for i in range(150)]
    rows += [(150 + i, [f(rng.gauss(0, 1)) for _ in range(64)]) for i in range(60)]
    rows += [(300 + i, rows[3][1]) for i in range(90)]  # a third of all rows is one vector
    rows += [(3, rows[9][1]), (None, rows[4][1]), (400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 63 + [None]), (404, [1.0] * 63 + [float("nan")]), (405, [float("-inf")] + [0.0] * 63)]
    df = vectors(spark, rows)
    want = brute_clusters(rows)
    assert got_clusters(df) == want
    clashing = df.select("*", *[F.lit(1).alias(c) for c in ("cluster", "distance", "v", "n", "start", "inertia")])
    assert got_clusters(clashing) == want


def test_few_vectors_ties_and_none(spark):
    rows = [(1, [0.0] * 64), (2, [1.0] + [0.0] * 63), (3, [0.5] + [0.0] * 63)]
    assert got_clusters(vectors(spark, rows)) == brute_clusters(rows)
    assert got_clusters(vectors(spark, rows), rounds=0) == brute_clusters(rows, rounds=0)  # a tie of two centroids is not there, but 1 and 2 are centroids themselves
    same = [(i, [2.0] * 64) for i in range(20)]
    assert got_clusters(vectors(spark, same)) == brute_clusters(same)
    assert centroid_clusters(vectors(spark, [])).count() == 0 and centroid_clusters(vectors(spark, [(1, None)])).count() == 0


def test_large_components_stay_exact_or_are_refused(spark):
    rows = [(i, [float((i * 37 + j * 11) % 97) * 1000 for j in range(64)]) for i in range(40)]
    assert max(max(v) for _, v in rows) * 1024 > EXACT
    assert got_clusters(vectors(spark, rows)) == brute_clusters(rows)
    with pytest.raises(Exception, match="would not fit a long"):
        centroid_clusters(vectors(spark, [(1, [1e30] * 64)]))


def test_balls_are_taken_whole_and_hold_their_sums():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-20, 20, (500, 64)) + 1000 * k for k in range(4)])
    order, nodes = tree(x)
    y = x[order]
    for a, b, s, r in zip(nodes["start"], nodes["end"], nodes["sums"], nodes["radius"]):
        assert (y[a:b].sum(axis=0) == s).all() and (np.sqrt(((y[a:b] - s / (b - a)) ** 2).sum(axis=1)) <= r).all()
    c = np.array([[1000 * k] * 64 for k in range(4)])
    whole, leaves = descend(y, nodes, c)
    n = nodes["end"] - nodes["start"]
    assert n[whole >= 0].sum() == 2000 and not leaves and (whole >= 0).sum() < 20
    assert (squared(y, c).argmin(axis=1) == np.concatenate([np.full(n[i], whole[i]) for i in sorted(np.flatnonzero(whole >= 0), key=lambda i: nodes["start"][i])])).all()


def test_first_centroids_follow_the_hash(spark):
    rows = [(i, [float(i)] * 64) for i in range(30)]
    want = sorted(range(30), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:8]
    assert [c[0] // 1024 for c in first_centroids(kept_vectors(vectors(spark, rows)))] == want


# ---- suffixes


def brute_dedup(rows, length):
    """Rows (doc_id, text) in the order that counts: by id, null last, equal ids by digest."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    raw.sort(key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1]).hexdigest()))
    seen, out = set(), Counter()
    for i, t in raw:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            g = t[a : a + length]
            if g in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(g)
        kept = bytes(c for c, x in zip(t, gone) if not x)
        out[i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def got_dedup(df, length=100):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, length).collect())


def repeated_texts(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 7)))
    make = lambda n: " ".join(word() for _ in range(n))
    passage, base = make(40), make(150)
    out = [None, "", "short", "x" * 700, "y" * 99, "y" * 100, "xy" * 200, "x" * 350, base, base, base[:400], base[200:], passage, passage + passage, "\x00" * 150, "a\x00" * 90]
    for _ in range(25):
        some = base.split(" ")
        some[rng.randrange(len(some))] = word()
        out.append(" ".join(some))
    out += [make(20) + passage + make(10) + base[50:220] + make(5) for _ in range(15)]
    return list(enumerate(out))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_dedup_matches_brute_force(spark):
    rows = repeated_texts()
    rows += [(7, rows[8][1]), (7, rows[8][1]), (None, rows[20][1]), (None, rows[20][1]), (None, "z" * 150), (3, "w" * 120)]
    df = docs(spark, rows)
    assert got_dedup(df) == brute_dedup(rows, 100)
    clashing = df.select("*", *[F.lit(1).alias(c) for c in ("d", "digest", "none", "off", "block", "n", "h", "lo", "rows")])
    assert got_dedup(clashing) == brute_dedup(rows, 100)


@pytest.mark.parametrize("length", [20, 100])
def test_dedup_over_many_parts_blocks_and_stretches(spark, monkeypatch, length):
    monkeypatch.setattr(suffixes, "PART", 700)
    monkeypatch.setattr(suffixes, "BLOCK", 1500)
    monkeypatch.setattr(suffixes, "STRETCH", 150)
    monkeypatch.setattr(suffixes, "PIECE", 400)
    monkeypatch.setattr(suffixes, "SAMPLED", 10)
    rows = repeated_texts(9)
    assert got_dedup(docs(spark, rows), length) == brute_dedup(rows, length)


def test_dedup_of_an_empty_table_and_without_repeats(spark, empty):
    assert suffix_dedup(empty).count() == 0
    rows = [(1, " ".join(str(i) for i in range(200))), (2, "other " + " ".join(str(i * i) for i in range(900, 1000)))]
    assert got_dedup(docs(spark, rows)) == brute_dedup(rows, 100)


def test_equal_windows_share_a_name():
    rng = random.Random(3)
    for _ in range(30):
        passage = bytes(rng.randrange(97, 100) for _ in range(60))
        texts = [bytes(rng.randrange(97, 120) for _ in range(rng.randrange(80))) + passage + bytes(rng.randrange(97, 120) for _ in range(rng.randrange(80))) for _ in range(3)]
        texts += [b"ab" * 70, b"", b"abc"]
        who, lo, n, name, _, own = window_names(texts, 30)
        at = {(w, a + i): (h, o) for w, a, k, h, o in zip(who.tolist(), lo.tolist(), n.tolist(), name.tolist(), own.tolist()) for i in range(k)}
        assert set(at) == {(w, a) for w, t in enumerate(texts) for a in range(len(t) - 29)}
        first, where = {}, {}
        for (w, a), (h, own_) in sorted(at.items()):
            g = texts[w][a : a + 30]
            assert first.setdefault(g, h) == h
            if g in where:  # the name occurs in another run, or the run says that it repeats within
                runs = {(x, y) for x, y, k, m in zip(who.tolist(), lo.tolist(), n.tolist(), name.tolist()) if m == h}
                assert len(runs) > 1 or own_
            where[g] = (w, a)


# ---- fill in the middle

ODD = ["", "a", "\n", "a\nb\n\nc", "\n\n", " lead and  two\tspaces ", "One. Two!? Three", "😀é\n日本 😀😀", "x" * 5000 + "\n" + "y" * 10, "a <P> b\nc", "<S>", "c<M>d\n", "a<\nb<P", None, "\r\n\r\nx\r", ".!?", "é\n"]
GRAMMAR = {"char": r"[\s\S]", "line": r"[^\n]*\n|[^\n]+", "word": r"\S+\s*|\s+", "run": r"\S+|\s+", "sentence": r"[^.!?]*[.!?]+|[^.!?]+"}


@pytest.mark.parametrize("grammar", list(GRAMMARS))
def test_units_follow_the_grammar(spark, grammar):
    df = spark.createDataFrame([(t,) for t in ODD if t is not None], "t string")
    for r in df.select("t", units(F.col("t"), grammar).alias("u")).collect():
        assert r.u == re.findall(GRAMMAR[grammar], r.t, re.A)


def brute_infill(i, text, grammar):
    t = text or ""
    u = re.findall(GRAMMAR[grammar], t, re.A)
    x = hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or "<P>" in t or "<S>" in t or "<M>" in t:
        return len(u), "plain", None, None, t
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("grammar", ["line", "char", "word"])
def test_infill_matches_and_is_rebuilt(spark, grammar):
    rows = [(k, t) for k, t in enumerate(ODD * 3)] + [(None, "a\nb"), (1, "again\nthe id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("u", "n", "a", "b", "form", "prefix")])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((i, *brute_infill(i, t, grammar)[:4], sha(brute_infill(i, t, grammar)[4]), sha(t or "")) for i, t in rows)
    assert Counter(tuple(r) for r in infill_digests(df, grammar).collect()) == want
    assert {r.form for r in infill_digests(df, grammar).collect()} == {"plain", "psm", "spm"}


def test_infill_rates_empty_table_and_plan(spark, empty, documents):
    assert infill_digests(empty).count() == 0
    assert {r.form for r in fill_in_middle(documents, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle(documents, spm_rate=100).where("form <> 'plain'").collect()} == {"spm"}
    plan = infill_digests(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan.split("Scan")[0].replace("Exchange RoundRobin", "")


def test_names_of_blocks_travel_without_their_bytes(spark, monkeypatch):
    """Two of three rounds sort by names alone; blocks' bytes went through the shuffle and the tables of each, and of the last step."""
    from marlspring.llm import suffixes

    made, returned = [], suffixes._returned
    monkeypatch.setattr(suffixes, "_returned", lambda blocks, *rest: made.append(blocks.columns) or returned(blocks, *rest))
    rng = np.random.default_rng(5)
    a, b = ("".join(chr(c) for c in rng.integers(97, 123, n)) for n in (150, 130))
    rows = [(1, a + b), (2, "x" + b + "y"), (3, a[:120] + "z"), (4, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (280, 0, 0), 2: (132, 130, 1), 3: (121, 120, 1), 4: (0, 0, 0)}
    assert ["buf" in c for c in made] == [False, False, True]


def test_blocks_and_runs_are_gone_before_the_last_sort(spark, monkeypatch):
    """The last sort moves most; blocks' bytes lay on the disks twice meanwhile, and so did the runs behind what is kept of them."""
    from marlspring.llm import suffixes

    told, forget, sort = [], suffixes._forget, suffixes.sort
    monkeypatch.setattr(suffixes, "_forget", lambda *tables: told.extend(t.columns for t in tables) or forget(*tables))
    monkeypatch.setattr(suffixes, "sort", lambda *a: told.append("sort") or sort(*a))
    text = "".join(chr(c) for c in np.random.default_rng(6).integers(97, 123, 300))
    rows = [(1, text), (2, "x" + text[:140] + "y"), (3, text[90:] + "z")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (300, 0, 0), 2: (142, 140, 1), 3: (211, 210, 1)}
    last = max(i for i, t in enumerate(told) if t == "sort")
    assert told.count("sort") == 4 and any({"buf", "doc_id"} <= set(t) for t in told[:last]) and sum("c" in t for t in told[: told.index("sort")]) == 3
