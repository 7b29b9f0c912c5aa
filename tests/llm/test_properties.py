"""Properties of the task-side helpers on generated texts; no Spark."""

import re

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlspring.llm.bpe import load
from marlspring.llm.hashing import runs, word_hashes
from marlspring.llm.html import HostWrapper, Places, blocks, main_text
from marlspring.llm.language import features, folded
from marlspring.llm.similarity import bitmap, bits_differ, shingle_sets
from marlspring.llm.token_files import LibraryEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = LibraryEncoder(PATH)
texts = st.text(st.one_of(st.sampled_from(list("ab \n\t.,'sé日1 \x1c<|>")), st.characters(exclude_categories=["Cs"])), max_size=120)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, max_size=6))
def test_both_encoders_equal_the_library(many):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in many]
    assert [np.frombuffer(b, "<u4").tolist() for b in ENCODER.encode(many)] == want
    got = [[int(i) for e in enc if e[0] for i in e[0].split(",")] for enc in load(PATH).encode(many)]
    assert got == want
    assert [b"".join(e[2] for e in enc).decode() for enc in load(PATH).encode(many)] == [LIBRARY.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, max_size=6))
def test_shingle_sets_have_the_right_sizes(many):
    _, at = shingle_sets(many)
    for t, n in zip(many, np.diff(at)):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        assert n == (len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else bool(w))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=40))
def test_bitmaps_never_overstate_a_difference(a, b):
    x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
    assert bits_differ(bitmap(x), bitmap(y)) <= len(a ^ b) and bits_differ(bitmap(x), bitmap(x)) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"bb", b"ccc"]), max_size=9), max_size=5))
def test_word_hashes_depend_on_the_word_alone(docs):
    h, at = word_hashes([b" ".join(d) for d in docs])
    names: dict[int, bytes] = {}
    for d, (s, e) in zip(docs, zip(at[:-1], at[1:])):
        assert e - s == len(d)
        for w, x in zip(d, h[s:e].tolist()):
            assert names.setdefault(x, w) == w
    assert len(runs(h, 2)) == max(0, len(h) - 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<article>", "</article>", "<div class='ad'>", "</div>", "<li>", "<td", "<", ">", "text", " ", "&amp;", "&", "<!--", "-->", "<script>", "</script>", "<br>", "<a href='x'>", "</a>", "<nav>", "</nav>"]), max_size=25).map("".join))
def test_any_markup_is_tolerated(page):
    w, places, known = HostWrapper(), Places(), {}
    found = blocks(page)
    w.see(found, [places.of(e, known) for e, _, _ in found], places)
    assert set(w.roles()) == {places.path(known[e]) if e else "" for e, _, _ in found}
    text = main_text(page, None)
    assert text == "\n\n".join(t for t in text.split("\n\n") if t.strip()) and all(" ".join(b[1].split()) == b[1] for b in blocks(page))


@settings(max_examples=80, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6))
def test_features_of_a_text_do_not_depend_on_its_neighbours(many):
    f = [folded(t) for t in many]
    together = features(f)
    assert all((features([x])[0] == together[k]).all() for k, x in enumerate(f))
