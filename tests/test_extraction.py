"""Field extraction, strict selection, content matching, nested values and paper metadata against brute force on odd rows."""

import json
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marlspring.operators import academic as A
from marlspring.operators import content as C
from marlspring.operators import extraction as X
from marlspring.operators import nested as J
from marlspring.operators import selection as S

# ---- fields from text


def one_by_one(text, rules):
    """Every rule as a search of its own."""
    found = []
    for i, r in enumerate(rules):
        if r.kind == "shape":
            found += [(r.field, i, r.many, next(g for g in m.groups() if g is not None), m.start(), m.end()) for m in re.finditer("|".join(r.terms), text, re.I)]
            continue
        at = 0
        longest = sorted(r.terms, key=len, reverse=True)
        while m := re.compile("|".join(map(re.escape, longest)), re.I).search(text, at):
            if r.kind == "token":
                found.append((r.field, i, r.many, m[0], m.start(), m.end()))
                at = m.end()
                continue
            rest = re.compile(r"[\s:：]*([^\n]*)" if r.kind == "label" else r"(?s)[\s:：]*(.+?)(?:\n\n|\Z)").match(text, m.end())
            if rest and rest[1].strip():
                found.append((r.field, i, r.many, rest[1].strip(), m.start(), rest.end(1)))
                at = rest.end(1)
            else:
                at = m.start() + 1
    return sorted(found, key=lambda f: (f[4], f[1]))


TABLES = {"meteorite": X.METEORITE, "organic": X.ORGANIC, "mineral": X.MINERAL, "insights": X.INSIGHTS, "references": X.REFERENCES}


@pytest.mark.parametrize("name", list(TABLES))
def test_one_pass_finds_what_single_searches_find(name):
    rng, rules = random.Random(1), TABLES[name]
    bits = [t for r in rules if r.kind != "shape" for t in r.terms] + ["Allende", "ALH84001", "ALH-84001", "12.5 kg", "3 ppm", "1969-02-08", "\n", "\n\n", ": ", "：", " ", "x", "Mineral", "ORGANIC Compound", "main"]
    find = X.scanner(rules)
    for _ in range(300):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", ": ", "\n"]) for _ in range(rng.randrange(12)))
        assert find(text) == one_by_one(text, rules), text


def test_fields_of_a_report(spark):
    text = "Name: Allende\nClassification: CV3\nFound at: Chihuahua\nconclusion: old\nMain conclusion: old\nresult: new\nReferences:\n[1] A. One\n\n[2] B"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "name:"), (5, "NAME" * 3000)], "doc_id long, text string").withColumn("field", F.lit("x"))
    got = {(r.doc_id, r.field): r.value for r in X.fields(X.scan(df, X.METEORITE + X.INSIGHTS)).collect()}
    assert got[1, "name"] == "Allende" and got[1, "classification"] == "CV3" and got[1, "conclusions"] == "old; new" and got[1, "location"] == "Chihuahua"
    assert {k[0] for k in got} == {1, 5}
    assert [(r.pos, r.line) for r in X.reference_lines(X.scan(df, X.REFERENCES)).collect()] == [(1, "[1] A. One")]
    assert X.fields(X.scan(df.limit(0), X.METEORITE)).count() == 0


def test_keys_of_any_type_and_repeats(spark):
    df = spark.createDataFrame([("a", "name: x"), ("a", "name: y"), (None, "name: z")], "k string, t string")
    assert sorted((r.k or "", r.value) for r in X.scan(df, X.METEORITE, "k", "t").collect()) == [("", "z"), ("a", "x"), ("a", "y")]


def test_overlapping_spans_leave_the_longest():
    rules = X.INSIGHTS
    found = X.scanner(rules)("finding: result: Y")
    assert [f[3] for f in found] == ["result: Y", "Y"] and [f[3] for f in X.longest_spans(found)] == ["result: Y"]


@pytest.mark.parametrize(
    ("context", "want"),
    [
        ("an LL 3 stone", {"classification": "LL3"}), ("Murchison Bay meteorite fell", {"name": "Murchison Bay"}), ("it was found in North West Africa, once", {"discovery_location": "North West Africa"}),
        ("parent body: Vesta type 4", {"origin": "Vesta type 4"}), ("", {}), (None, {}), ("from A Very Long Name Of Some Unknown Place Far Away.", {}),
    ],
)
def test_what_is_unknown_is_filled(spark, context, want):
    row = {"classification": "Unknown", "name": None, "discovery_location": " ", "origin": "Not specified"}
    df = spark.createDataFrame([Row(**row, context=context), Row(classification="H5", name="N", discovery_location="P", origin="O", context=context)], "classification string, name string, discovery_location string, origin string, context string")
    a, b = X.fill_missing(df, "context").collect()
    assert {k: a[k] for k in row} == row | want and a.filled == len(want)
    assert (b.classification, b.name, b.discovery_location, b.origin, b.filled) == ("H5", "N", "P", "O", 0)


# ---- strict selection


def walk(rows, st=S.CORE):
    """The assessment as a walk that counts the tags of accepted rows."""
    norm = lambda v: re.sub(r"\s+", " ", v or "").strip().lower()
    split = lambda v: [x.strip() for x in (v or "").split(";") if x.strip()]
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: r["k"]):
        title, tags, n = norm(r["doc_name"]), split(r["candidate_tags"]), len(split(r["projected"]))
        hard = {v for t, v in st.hard.items() if t in title} | {v for t, v in st.hard_tags.items() if t in tags}
        hard |= {v for t, (v, terms) in st.tag_terms.items() if t in tags and any(x in title for x in terms)} | ({S.MISSING} if n == 0 else set())
        named = bool(norm(r["name"]))
        anchored = named or any(t in title for t in st.core)
        soft = {v for t, v in st.soft.items() if t in title} | (set() if anchored else {S.WEAK})
        gaps = [t for t in tags if t in st.hints and t not in seen]
        if not hard and not soft and anchored and n >= 2:
            like = "recommended_core_now"
        elif not hard and anchored and n >= 1 and not soft & set(st.reserve):
            like = "backup_after_scope_check"
        elif not hard and n >= 1 and soft & set(st.reserve):
            like = "reserve_not_recommended_first"
        else:
            like = "excluded"
        score = (r["priority_score"] or 0) + 2 * named + (2 if n >= 3 else 1 if n else 0) + 2 * bool(norm(r["organic_snippet"])) + bool(norm(r["name_snippet"]))
        score += any(x in (r["section_hints"] or "") for x in ("results_or_analytical", "table_or_caption")) + min(3, len(gaps)) + 3 * ("likely_core_gold" in (r["recommendation"] or ""))
        score += {"high": 3, "medium": 1}.get(r["review_priority"], 0) - 100 * bool(hard) - 10 * len(soft)
        if like != "excluded":
            seen |= set(tags)
        out[r["k"]] = (like, score, gaps, sorted(hard), sorted(soft))
    return out


SELECTION = "k long, doc_name string, candidate_tags string, projected string, name string, organic_snippet string, name_snippet string, section_hints string, recommendation string, review_priority string, priority_score int"


def candidates(n=120):
    rng = random.Random(6)
    some = lambda xs, sep, k: sep.join(rng.sample(xs, rng.randrange(k)))
    pick = lambda *xs: rng.choice(xs)
    titles = ["A Meteorite", "study of  ICES", "Review", "Ryugu grains", "Martian rock", "bennu", "comet 67P", "curation", "analog", "note"]
    return [
        {"k": i, "doc_name": pick(None, some(titles, " ", 4), some(titles, " ", 3)), "candidate_tags": pick(None, some([*S.CORE.hints, "martian_sample", "contamination_qc", "other"], "; ", 6)), "projected": pick(None, "a", "a;b", "a; b;;c"), "name": pick(None, " ", "Murchison"),
         "organic_snippet": pick(None, "x"), "name_snippet": pick("", "y"), "section_hints": pick(None, "table_or_caption; x", "z"), "recommendation": pick(None, "likely_core_gold"), "review_priority": pick(None, "high", "medium", "low"), "priority_score": pick(None, 0, 7, 12)}
        for i in range(n)
    ]


def test_assessment_equals_a_walk_over_the_rows(spark):
    rows = candidates()
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SELECTION.split(", ")) for r in rows], SELECTION).repartition(5)
    got = {r.k: (r.likelihood, r.score, r.gaps, r.hard, r.soft) for r in S.assess(df, ["k"]).collect()}
    assert got == walk(rows) and len({v[0] for v in got.values()}) == 4
    assert S.assess(df.limit(0), ["k"]).count() == 0


def test_selection_leaves_overflow_and_no_second_title(spark):
    df = S.assess(spark.createDataFrame([tuple(r[c.split()[0]] for c in SELECTION.split(", ")) for r in candidates()], SELECTION), ["k"])
    best, rest = S.select_core(df, 5, "k")
    scores = sorted((r.score for r in df.where("include").collect()), reverse=True)
    chosen, others = best.collect(), rest.collect()
    assert [r.score for r in chosen] == scores[:5] and {r.k for r in chosen}.isdisjoint(r.k for r in others)
    assert {r.reason for r in others if r.include} == {"reserve_overflow_after_limit"}
    titles = {re.sub("[^a-z0-9]+", " ", " ".join((r.doc_name or "").split()).lower()).strip() for r in chosen} - {""}
    assert all(re.sub("[^a-z0-9]+", " ", " ".join((r.doc_name or "").split()).lower()).strip() not in titles for r in others)


# ---- content


def test_content_matches_equal_all_pairs(spark):
    rng = random.Random(3)
    likes = [(u, f"f{f}", rng.choice([-1.0, -0.5, 0.2, 0.6, 0.9])) for u in range(12) for f in rng.sample(range(8), 4)]
    has = [(i, f"f{f}", rng.choice([-0.8, 0.1, 0.5, 1.0])) for i in range(60) for f in [0, *rng.sample(range(1, 8), 3)]]  # one feature that all items have
    seen = [(u, i) for u in range(12) for i in rng.sample(range(60), 9)]
    want = {}
    for u in range(12):
        for i in range(60):
            p, v = {f: w for x, f, w in likes if x == u}, {f: w for x, f, w in has if x == i}
            both = p.keys() & v.keys()
            s = sum(p[f] * v[f] * abs(p[f]) for f in both) / sum(abs(p[f]) for f in both) if both else 0
            if s > 0.3 and (u, i) not in seen:
                want[u, i] = round(s, 9)
    frames = [spark.createDataFrame(r, s).withColumn("salt", F.lit(1)) for r, s in ((likes + [(1, None, 1.0), (2, "f1", None)], "user long, feature string, weight double"), (has, "item long, feature string, value double"), (seen, "user long, item long"))]
    assert {(r.user, r.item): round(r.similarity, 9) for r in C.content_matches(*frames).collect()} == want and want
    assert C.content_matches(*[f.limit(0) for f in frames]).count() == 0
    with pytest.raises(ValueError, match="0 or more"):
        C.content_matches(*frames, threshold=-0.1)


# ---- nested values


def depth(x):
    return 1 + max([depth(v) for v in (x.values() if isinstance(x, dict) else x)], default=0) if isinstance(x, (dict, list)) else 0


def n_fields(x):
    return len(x) + sum(map(n_fields, x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, list)) else 0


def all_words(x, prefix=""):
    out = []
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        full = f"{prefix}.{k}" if prefix else str(k)
        out.append(full)
        if isinstance(v, str) and len(v) > 2:
            out.append(v.lower())
        elif isinstance(v, (dict, list)):
            out += all_words(v, full)
    return list(dict.fromkeys(out))


def some_json(rng, level=0):
    if level > 3 or rng.random() < 0.35:
        return rng.choice([1, -2.5, None, True, "", "ab", "A{b}[c],:", 'q"uo\\te', "line\nbreak", "日本語テ", "\\"])
    return [some_json(rng, level + 1) for _ in range(rng.randrange(4))] if rng.random() < 0.5 else {rng.choice(["k", "n{", "日", 'x"', "a b", "long" * 9]) + str(j): some_json(rng, level + 1) for j in range(rng.randrange(4))}


def test_measures_and_keywords_of_any_json(spark):
    rng = random.Random(8)
    values = [some_json(rng) for _ in range(150)] + [{}, [], [[]], {"a": {}}, 5, "text", None]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for v in values]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, j string")
    got = {r.k: r for r in J.object_measures(df, "k", "j").collect()}
    words = {r.k: r.w for r in df.select("k", J.keywords(F.col("j")).alias("w")).collect()}
    for k, v in enumerate(values):
        assert (got[k].depth, got[k].fields, got[k].nested) == (depth(v), n_fields(v), depth(v) > 1), texts[k]
        assert got[k].size == len(json.dumps(json.loads(texts[k]), ensure_ascii="\\u" in texts[k], separators=(",", ":"))) or "\\u" in texts[k]
        assert words[k] == all_words(v), texts[k]
    bad = spark.createDataFrame([(1, "{"), (2, None), (3, ""), (4, "{'a': 1}")], "k long, j string")
    assert all(r.depth is None and r.size is None for r in J.object_measures(bad, "k", "j").collect())


def test_recovered_json(spark):
    rng = random.Random(2)
    whole = [{"a": some_json(rng), "b": some_json(rng)} for _ in range(60)]
    cases = [(f"Sure: {json.dumps(v)} and {{so}} on }}", v) for v in whole] + [(f"```json\n{json.dumps(v, indent=1)}\n``` {{", v) for v in whole]
    cases += [(None, None), ("", None), ("no value", None), ("} {", {}), ("{not json}", None), ('{"a": 1', {"a": 1}), ('{"a": [1, 2, {"b": "x', {"a": [1, 2, {"b": "x"}]}), ('{"a": 1, "b', {"a": 1}), ('{"a": 1, "b":', {"a": 1}), ('{"a": "x}y{', {"a": "x}y{"}), ('{"a": "q\\', {"a": "q"}), ('x {"a": [1,', {"a": [1]}), ('{"a": {"b": 2}} {"c": 3}', {"a": {"b": 2}}), ('{"a": "' + "y" * 50_000 + '"', {"a": "y" * 50_000})]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k long, t string")
    for r in df.select("k", J.balanced_json(F.col("t")).alias("j")).collect():
        assert (json.loads(r.j) if r.j is not None else None) == cases[r.k][1], cases[r.k][0][:200]


def test_cut_anywhere_still_parses(spark):
    text = json.dumps({"name": 'a "quoted" {thing}', "list": [1, [2, {"x": "y\\z"}], "end"], "more": {"deep": [True, None]}})
    df = spark.createDataFrame([(n, text[:n]) for n in range(2, len(text) + 1)], "n long, t string")
    got = {r.n: r.j for r in df.select("n", J.balanced_json(F.col("t")).alias("j")).collect()}
    assert json.loads(got[len(text)]) == json.loads(text)
    parsed = [n for n, j in got.items() if j is not None and isinstance(json.loads(j), dict)]
    assert len(parsed) > 0.8 * len(got)  # what is left out ends within a word such as tru or after a name in a list's object


# ---- papers


PAPER = """Astrophysical Letters 12 (2019)
10.1234/meteor-99
0004-637X 783 2 140
On the Origin of Amino Acids
 in Carbonaceous Chondrites
John Smith, Mary Jones
Received 3 May 2018

Abstract
We measured amino acids in many stones and found that several of them are old enough.

Keywords: amino acids, stones
Introduction
The text goes on, as in Icarus 2050."""


def paper(spark, text):
    return A.paper_metadata(spark.createDataFrame([(1, text)], "doc_id long, text string"), 2026).first()


def test_paper_metadata(spark):
    r = paper(spark, PAPER)
    assert (r.doi, r.year, r.journal, r.keywords) == ("10.1234/meteor-99", 2019, "meteor", "amino acids, stones")
    assert r.title == "On the Origin of Amino Acids in Carbonaceous Chondrites John Smith, Mary Jones"
    assert r.abstract == "We measured amino acids in many stones and found that several of them are old enough."
    assert r.authors == "Astrophysical Letters"  # the first pair of capitalised words, as the survey has it


@pytest.mark.parametrize("text", [None, "", "\n\n\n", "short", "0004-637X 783 2 140"])
def test_papers_without_anything(spark, text):
    r = paper(spark, text)
    assert all(r[c] is None for c in ("doi", "year", "journal", "authors", "title", "abstract", "keywords"))


def test_a_long_text_is_no_trouble(spark):
    r = paper(spark, PAPER + "\nword and Word " * 40_000)
    assert r.year == 2019 and r.journal == "meteor"
