"""Queries without SQL against brute force, on tables that hold more than the ids and prefixes once cut to."""

from difflib import SequenceMatcher

from marlspring.operators import normalize as E
from marlspring.plans import listing, records


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_best_match_takes_all_customers(spark, tmp_path):
    names = {k: f"Customer#{k:09d}" for k in [*range(1, 32), *range(595, 631), 12345]}
    write(spark, tmp_path, "customer", list(names.items()), "c_custkey long, c_name string")
    want = {}
    for k, a in names.items():
        near = [(SequenceMatcher(None, a, b).ratio(), -j) for j, b in names.items() if j != k and a[:17] == b[:17]]
        if near and max(near)[0] >= 0.9:
            want[k] = -max(near)[1]
    assert {r.new_key: r.old_key for r in records.best_match(spark, str(tmp_path)).collect()} == want
    assert {2, 612} <= want.keys()


def picks(rows, k):
    left, seen, out = dict(rows), set(), []
    while left and len(out) < k:
        best = max(left, key=lambda x: (left[x][0] + 2 * len(set(left[x][1]) - seen) - len(set(left[x][1]) & seen), -x))
        seen |= set(left.pop(best)[1])
        out.append(best)
    return out


def test_diverse_picks_take_all_sizes(spark, tmp_path):
    words = "red blue small ring bolt gear".split()
    parts = [(k, f"type{k * k % 3}", k * 7 % 11, f"{words[k % 6]} {words[k * k % 5]} {words[k % 2]}") for k in range(1, 200)]
    write(spark, tmp_path, "part", parts, "p_partkey long, p_type string, p_size int, p_name string")
    found = {}
    for r in sorted(records.diverse_picks(spark, str(tmp_path)).collect(), key=lambda r: r.pos):
        found.setdefault(r.p_type, []).append(r.p_partkey)
    assert found == {t: picks([(k, (size % 5, name.split(" "))) for k, u, size, name in parts if u == t], 5) for t in {p[1] for p in parts}}


def test_pick_diverse_gathers_few_of_many_equal_rows(spark):
    rows = [("g", k, 1, ["a", "b"] if k % 2 else ["b", "a", "a"]) for k in range(300)] + [("g", 900, 0, ["c"])]
    df = spark.createDataFrame(rows, "g string, k long, base int, tags array<string>")
    assert [r.k for r in E.pick_diverse(df, "g", "k", 4).orderBy("pos").collect()] == picks([(k, (b, t)) for _, k, b, t in rows], 4)


def test_mojibake_repair_takes_whole_texts(spark, tmp_path):
    texts = {1: "plain " * 30, 2: "x" * 100 + " déjà vu", 3: "é" * 90, 4: "", 5: None}
    write(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: (r.text, r.repaired) for r in listing.mojibake_repair(spark, str(tmp_path)).collect()}
    assert rows[2][0] == texts[2].encode().decode("latin-1") and rows[3][1] == texts[3] and rows[2][1] == texts[2]
    assert rows[1] == (texts[1], texts[1]) and rows[4] == ("", "") and rows[5] == (None, None)
