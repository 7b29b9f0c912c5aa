import hashlib
import re
import time
from array import array
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marlspring.llm import bpe as B
from marlspring.llm.bpe import bpe_decode, bpe_digests, bpe_encode
from marlspring.llm.decontamination import decontaminate, decontaminated
from marlspring.llm.language import codewords, language_filter, language_id
from marlspring.llm import licenses as L
from marlspring.llm.licenses import Automaton, license_scan
from marlspring.llm import quality
from marlspring.llm.quality import quality_filter, quality_rules

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_bpe_equals_the_library(documents, odd_texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = {r.doc_id: r for r in bpe_digests(documents, PATH).collect()}
    for k, text in enumerate(odd_texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (rows[k].n_tokens, rows[k].ids_sha256, rows[k].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), text[:50]


def test_bpe_round_trip(documents, odd_texts, empty, clashing):
    back = {r.doc_id: r.text for r in bpe_decode(bpe_encode(clashing, PATH), PATH).collect()}
    assert back == {k: t or "" for k, t in enumerate(odd_texts)}
    assert bpe_digests(empty, PATH).count() == 0


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep)


def test_quality_measures(clashing, odd_texts, empty):
    rows = {r.doc_id: r for r in quality_rules(clashing).collect()}
    for k, t in enumerate(odd_texts):
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), (t or "")[:60]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules(empty).count() == 0
    kept = quality_filter(clashing)
    assert kept.columns == clashing.columns and 0 < kept.count() == sum(r.kept for r in rows.values())


def test_quality_is_native(documents):
    plan = quality_rules(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_hits(text, items):
    w = re.findall(ALNUM, lower(text))
    hit, found = set(), set()
    for i, t in items:
        v = re.findall(ALNUM, lower(t))
        n = min(10, len(v))
        for s in range(len(v) - n + 1) if v and i is not None else []:
            for a in range(len(w) - n + 1):
                if w[a : a + n] == v[s : s + n]:
                    hit |= set(range(a, a + n))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(spark, documents, odd_texts, empty):
    a, b = odd_texts[9].split(), odd_texts[8].split()
    items = [(1, " ".join(a[5:30])), (2, " ".join(b[100:150]) + " other words here"), (10, "one two three"), (3, None), (4, " ... "), (5, "teSt"), (1, " ".join(a[5:30])), (None, "one"), (6, " ".join(a[:10])), (7, "a b c a b c a b c a b c"), (8, "日本語")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(0))
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(documents, bench).collect()}
    assert rows == {k: brute_hits(t, items) for k, t in enumerate(odd_texts)}
    assert decontaminate(empty, bench).count() == 0
    none = decontaminate(documents, bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(odd_texts)
    clean = decontaminated(documents, bench)
    assert clean.columns == documents.columns and {r.doc_id for r in clean.collect()} == {k for k, v in rows.items() if not v[4]}


def test_items_keep_ids_of_any_type(spark, documents, odd_texts):
    a = odd_texts[9].split()
    items = [("b-1", " ".join(a[5:30])), ("a", "teSt")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(documents, bench).collect()}
    assert rows == {k: brute_hits(t, items) for k, t in enumerate(odd_texts)} and any(r[4] for r in rows.values())


def test_decontamination_searches_every_text_of_an_item_id(spark, documents, odd_texts):
    a, b = odd_texts[9].split(), odd_texts[8].split()
    items = [(1, " ".join(a[5:30])), (1, " ".join(b[100:150])), (1, " ".join(b[300:311])), (2, "one two three"), (2, " ".join(a[:10])), (2, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(documents, bench).collect()}
    assert rows == {k: brute_hits(t, items) for k, t in enumerate(odd_texts)}


def test_license_scan(spark, documents, odd_texts, empty):
    said = {900: "This work is licensed under the GNU General Public License, version 3.", 901: "x MIT License y mit-license", 902: "Licensed under CC BY-NC 4.0.", 903: "cc by", 904: "Licensed under the terms of the Apache License, Version 2.0"}
    rows = documents.select("doc_id", "text").union(spark.createDataFrame(list(said.items()), "doc_id long, text string"))
    found = {r.doc_id: r for r in license_scan(rows).collect()}
    for k, t in [*enumerate(odd_texts), *said.items()]:
        w, places = re.findall(ALNUM, lower(t)), []
        for p in ("gnu general public license", "apache license", "cc by", "mit license"):
            p = p.split()
            places += [a for a in range(len(w)) if w[a : a + len(p)] == p]
        assert (found[k].n_words, found[k].n_base, found[k].first_word, found[k].last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
    assert [found[k].labels for k in sorted(said)] == ["gpl,gpl-3.0", "mit", "cc-by,cc-by-nc-4.0", "cc-by", "apache,apache-2.0"]
    assert found[903].score == 0.5 and found[0].score == 0.0
    assert license_scan(empty).count() == 0


@pytest.mark.parametrize(("text", "accepted"), [("a b d", True), ("a x b d", True), ("a x b q q d", True), ("a b q q q d", False), ("a x d", False), ("z a b d z", True), ("a", False)])
def test_template_automaton(text, accepted):
    a = Automaton("t", "a <<optional: x>> b <<var: 2>> d")
    w = text.encode().split()
    assert any(a.accepts(w, k) for k in range(len(w)) if w[k] in a.first) == accepted


def test_language_id_on_held_out(spark):
    vocab = {"en": "the of and that with this from which have been", "de": "der die und nicht mit einer auch werden über für", "fr": "les des est dans pour une qui avec être été"}
    import random

    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(vocab[name].split(), k=rng.randrange(5, 60))), name) for k in range(400) for name in [sorted(vocab)[k % 3]]]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "de"), (None, "the of and", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    found = language_id(df).collect()
    assert len(found) == len(rows)
    truth = {i: name for i, _, name in rows}
    wrong = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 1000 and r.lang_pred != truth[r.doc_id]]
    assert len(wrong) <= 2
    by = {r.doc_id: r for r in found}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1000, 1001, 1002))
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    kept = language_filter(df)
    assert kept.columns == df.columns and 1000 not in {r.doc_id for r in kept.collect()}


def test_numbers_have_no_language(spark):
    rows = [(4 * k, f"the and of {w} with", "en") for k, w in enumerate("a b c d".split())] + [(40 + 4 * k, f"der die und {w} mit", "de") for k, w in enumerate("a b c d".split())]
    odd = ["½ ² Ⅷ 12", "①②", "²", "_ 7", "٣", "…", None, ""]
    df = spark.createDataFrame([*rows, *[(1000 + k, t, None) for k, t in enumerate(odd)], (2000, "x²", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language_id(df).collect()}
    assert {found[1000 + k] for k in range(len(odd))} == {"und"} and found[2000] != "und"


def test_language_id_without_labels(documents, empty):
    assert {r.lang_pred for r in language_id(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in language_id(documents).collect()} == {"und", "en"}
    assert language_id(empty).count() == 0


def test_codewords_are_distinct():
    for n in (2, 3, 4, 6, 9, 40):
        code = codewords(n)
        assert len({tuple(c) for c in code}) == n and (abs(code.sum(axis=0)) < n).all()


def test_texts_whose_positions_do_not_fit_are_counted_by_whole_hashes(documents, monkeypatch):
    want = {(r.doc_id, r.n_repeat_words) for r in quality.quality_rules(documents).collect()}
    monkeypatch.setattr(quality, "_INDEX_BITS", 4)
    assert {(r.doc_id, r.n_repeat_words) for r in quality.quality_rules(documents).collect()} == want


def test_rules_are_ordered_by_what_is_left_for_them(spark):
    """A rule that only rejects what another has rejected before comes after one with rejections of its own."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(80)) + (" " + "!" * 150 if k % 2 else "") + (" ://" if k % 4 == 0 else "")) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loud = "length(text) - length(replace(text, '!', '')) > 100"
    rules = (quality.Rule("loud", loud), quality.Rule("loud_too", f"{loud} AND doc_id >= 0"), quality.Rule("links", "contains(text, '://')"))
    order = [r.name for r in quality.rule_order(docs, rules)]
    assert order == ["loud", "links", "loud_too"]


def test_rules_are_ordered_by_rejections_per_cost_and_always_alike(spark, documents):
    """A dear rule comes after a cheap one that rejects a little less; the same table gives the same order and rules again."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(80)) + (" ://" if k % 2 else "") + (" ..." if k % 5 == 0 else "")) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dear = quality.Rule("dear", "contains(text, '://')", f"{quality.REGEX} * length(text)")
    cheap, never = quality.Rule("cheap", "contains(text, '...')", f"{quality.PLAIN} * length(text)"), quality.Rule("never", "n_words < 0")
    assert [r.name for r in quality.rule_order(docs, (never, dear, cheap))] == ["cheap", "dear", "never"]
    assert [r.name for r in quality.rule_order(docs.limit(0), (never, dear, cheap))] == ["never", "dear", "cheap"]  # as given: nothing is known
    orders = [[r.name for r in quality.rule_order(documents.repartition(n))] for n in (1, 3, 5)]
    assert orders[0] == orders[1] == orders[2] and sorted(orders[0]) == sorted(r.name for r in quality.RULES)


def test_long_words_merge_as_short_ones_do():
    import random

    rng = random.Random(2)
    tok = B.Bpe(PATH)
    for word in ("a" * 3001, "".join(rng.choice("etaoinshr") for _ in range(2500)), "日本語" * 400, "ab" * 1000):
        ids, _ = tok.merge([word.encode()])
        assert tok.merge_long(word.encode()) == ids.tolist()
    began = time.perf_counter()
    (got,) = tok.encode(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))])
    assert sum(n for _, n, _ in got) > 1000 and not tok.cache and time.perf_counter() - began < 60


def test_caches_are_bounded_by_bytes(monkeypatch, odd_texts):
    from tokenizers import Tokenizer

    from marlspring.llm import token_files as T

    monkeypatch.setattr(B, "CACHE_BYTES", 3000)
    monkeypatch.setattr(T, "CACHE_BYTES", 3000)
    lib, tok, enc = Tokenizer.from_file(PATH), B.Bpe(PATH), T.LibraryEncoder(PATH)
    for t in odd_texts:
        want = lib.encode(t or "", add_special_tokens=False).ids
        (one,) = tok.encode([t])
        assert [int(i) for ids, _, _ in one if ids for i in ids.split(",")] == want
        assert array("I", next(iter(enc.encode([t])))).tolist() == want
    assert tok.held <= 3000 + 200 * B.LONG_PIECE and all(d.held <= 3000 + 200 + 17 * B.LONG_PIECE and sum(map(len, d)) < 10_000 for d in (enc.first, enc.spaced))


def test_a_pattern_of_its_own_is_left_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    from marlspring.llm import token_files as T

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "[0-9]|[^0-9]+"}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    text = "room 1234 of the house, 56x"
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert array("I", next(iter(T.LibraryEncoder(path).encode([text])))).tolist() == want
    with pytest.raises(ValueError, match="pre-tokenizer"):
        B.Bpe(path)


def test_places_of_a_long_document_fill_several_rows(spark, monkeypatch):
    from marlspring.llm import decontamination as D

    monkeypatch.setattr(D, "PLACES", 7)
    item = " ".join(f"w{k}" for k in range(40))
    rows = [(1, " ".join([item] * 20) + " tail"), (2, "none of it"), (3, None), (4, "x " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (5, item), (6, "w38 w39")], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate(docs, bench).collect()}
    assert found == {1: (801, 800, 2), 2: (3, 0, 0), 3: (0, 0, 0), 4: (41, 40, 2)}


def brute_labels(words):
    """The labels and score by regular expressions made of the templates, tried at every word."""
    text = "".join(" " + w for w in words)
    starts = [m.start() for m in re.finditer(" ", text)]
    found, score = set(), 0.0
    for kind, templates in (("text", L.TEXTS), ("notice", L.NOTICES)):
        for label, markup in templates:
            parts = re.findall(r"<<(optional|var): ([^>]*)>>|(\S+)", markup)
            made = "".join("(?:" + "".join(" " + re.escape(w) for w in inner.split()) + ")?" if kind_ == "optional" else rf"(?: \S+){{0,{inner}}}" if kind_ == "var" else " " + re.escape(word) for kind_, inner, word in parts)
            pattern = re.compile(made + r"(?= |\Z)")
            for k, at in enumerate(starts):
                if pattern.match(text, at) and not (kind == "notice" and {"not", "never", "isn", "don", "nor", "without"} & set(words[max(0, k - 4) : k])):
                    found.add(label)
                    score = max(score, {"text": 1.0, "notice": 0.9}[kind])
    return found, score


def test_licence_labels_equal_brute_force(spark, clashing, odd_texts):
    import random

    rng = random.Random(8)
    said = ["Not released under the MIT License.", "It is never, ever licensed under the Apache License, Version 2.0!", "not this: released under the MIT license", "copyright 2020 by a b c all rights reserved", None, ""]
    for label, markup in L.TEXTS:
        filled = re.sub(r"<<var: \d+>>", lambda m: " ".join(f"name{rng.randrange(9)}" for _ in range(rng.randrange(3))), markup)
        whole = re.sub(r"<<optional: ([^>]*)>>", lambda m: m[1] if rng.random() < 0.5 else "", filled).split()
        said += [f"Title of {label}\n\n" + " ".join(whole).upper() + " and more", " ".join(whole[:-1]), " ".join([*whole[:9], "other", *whole[9:]]), " ".join(whole) + " " + " ".join(whole)]
    texts = [*odd_texts, *said]
    rows = clashing.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(said, len(odd_texts))), "doc_id long, text string"))
    found = {r.doc_id: r for r in license_scan(rows.union(rows.where("doc_id % 7 = 0"))).collect()}
    for k, t in enumerate(texts):
        labels, score = brute_labels(re.findall(ALNUM, lower(t)))
        base = set(found[k].base_labels.split(",")) - {""}
        assert (found[k].labels, found[k].score) == (",".join(sorted(labels | base)), score or (0.5 if base else 0.0)), (t or "")[:80]
    accepted = [found[k].score for k in range(len(odd_texts) + 6, len(texts))]
    assert accepted[0::4] == [1.0] * len(L.TEXTS) == accepted[3::4] and max(accepted[1::4] + accepted[2::4]) < 1.0
