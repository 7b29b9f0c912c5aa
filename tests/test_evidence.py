"""Evidence selection against the walk that it stands for."""

import random

import pytest
from pyspark.sql import functions as F

from marlspring.operators import evidence as E


def walk(chunks, most, strong=False):
    """chunks by rank: dicts with index, place, special, reference, strong; the picks in order."""
    picks = sorted((c for c in chunks if c["place"]), key=lambda c: c["place"])
    if any(c["special"] and (not strong or c["strong"]) for c in picks):
        return [c["index"] for c in picks[:most]]
    for c in chunks:
        if not c["place"] and not c["reference"] and c["special"]:
            if len(picks) >= most and picks:
                picks[-1] = c
            else:
                picks.append(c)
            break
    return [c["index"] for c in picks[:most]]


@pytest.mark.parametrize("strong", [False, True])
def test_special_evidence_equals_the_walk(spark, strong):
    rng, rows, want = random.Random(7), [], {}
    for doc in range(80):
        n, k = rng.randrange(1, 9), rng.randrange(0, 4)
        chunks = [{"index": i, "special": rng.random() < 0.3, "reference": rng.random() < 0.3, "strong": rng.random() < 0.5, "place": None} for i in rng.sample(range(20), n)]
        for place, c in enumerate(rng.sample(chunks, min(k, n)), 1):
            c["place"] = place
        want[doc] = walk(chunks, 3, strong)
        rows += [(doc, c["index"], rank, c["place"], c["special"], c["reference"], c["strong"]) for rank, c in enumerate(chunks, 1)]
    df = spark.createDataFrame(rows, "doc long, i long, rank int, place long, sp boolean, ref boolean, st boolean").repartition(4)
    got = {d: [] for d in want}
    for r in E.with_special(df, "doc", "i", 3, F.col("sp"), F.col("ref"), F.col("st") if strong else None).orderBy("doc", "place").collect():
        got[r.doc].append(r.i)
    assert got == want
    assert E.with_special(df.limit(0), "doc", "i", 3, F.col("sp"), F.col("ref")).count() == 0


@pytest.mark.parametrize(("text", "want"), [(None, False), ("", False), ("References", True), ("A et al. and B et al.", True), ("doi 1999 2001", True), ("1999 2000", False), ("1990 1991 1992 1993 2001", True)])
def test_lists_of_references(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(E.reference_like(F.col("t")).alias("x")).first().x is want


def test_classes_join_a_records_tokens(spark):
    rows = spark.createDataFrame([(1, "amines; ; PAHs", "On dimethyl sulfide"), (2, None, None), (3, "primordial organic matter", "x")], "k long, tokens string, title string")
    seen = [(1, 1, "volatile organic compounds and Volatile Organic Compound"), (1, 2, "references: primordial organic matter"), (3, 1, "primordial organic matter"), (3, 2, None), (4, 1, "x")]
    got = {r.k: r.tokens for r in E.augmented(rows, spark.createDataFrame(seen, "k long, place long, content string"), "k", "tokens", "title").collect()}
    assert got == {1: "amines; PAHs; dimethylsulfides; volatile organic compounds", 2: "", 3: "primordial organic matter"}


def test_special_by_field(spark):
    df = spark.createDataFrame([("see Table 1",), ("peak found",), ("a blank run",), ("dimethylsulfide",), (None,)], "t string")
    kinds = {f: [bool(r.x) for r in df.select(E.special(F.col("t"), f, True).alias("x")).collect()] for f in ("organic_compounds", "contamination_controls", "name")}
    assert kinds == {"organic_compounds": [True, True, False, True, False], "contamination_controls": [True, False, True, False, False], "name": [False] * 5}
