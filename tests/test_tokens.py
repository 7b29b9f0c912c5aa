"""Chunks by tokens against the library's own decoding."""

import base64
import random

import pytest

from marlspring.operators import tokens as T
from marlspring.plans import tokens as plan

public = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_hand(text, size, overlap):
    """Windows of ids, decoded by the library; the place is that of the window's first byte."""
    enc, out, s = library(), [], 0
    ids = enc.encode_ordinary(text or "")
    while s < len(ids):
        e = min(s + size, len(ids))
        before, piece = enc.decode_bytes(ids[:s]), enc.decode_bytes(ids[s:e])
        content = piece.decode(errors="replace").strip()
        if content:
            try:
                at = len(before.decode()) + len(piece.decode()) - len(piece.decode().lstrip())
                out.append((len(out), s, e, at, at + len(content), content))
            except UnicodeDecodeError:
                out.append((len(out), s, e, -1, -1, content))
        if e == len(ids):
            break
        s = max(e - overlap, s + 1)
    return out


@pytest.mark.parametrize(("size", "overlap"), [(5, 2), (3, 0), (2, 2), (1, 5), (700, 80)])
def test_chunks_are_the_library_windows(spark, size, overlap):
    r = random.Random(size)
    texts = ["plain words again plain words again " * 3, "", None, "   \n ", "x" * 300, "日本語の文章 𝄞𝄞 ½ é", "<|endoftext|> is text", "".join(r.choice("aé日𝄞 \n") for _ in range(150)), "日" + " " * 40 + "本"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id long, text string, content int").withColumnRenamed("content", "start_char")
    found = {}
    for row in T.token_chunks(df, PATH, PATTERN, "id", "text", size, overlap).orderBy("id", "chunk_index").collect():
        found.setdefault(row.id, []).append(tuple(row)[1:])
    assert found == {k: c for k, t in enumerate(texts) if (c := by_hand(t, size, overlap))}
    for k, chunks in found.items():
        assert all(text == texts[k][a:b] for *_, a, b, text in chunks if a >= 0)


def test_split_characters_have_no_place_and_the_rest_do(spark):
    places = [c[3] for c in by_hand("𝄞𝄞𝄞", 1, 0)]
    assert -1 in places
    df = spark.createDataFrame([("a", "𝄞𝄞𝄞"), ("a", "𝄞𝄞𝄞"), (None, "z")], "id string, text string")
    rows = T.token_chunks(df, PATH, PATTERN, "id", "text", 1, 0).collect()
    assert sorted(x.start_char for x in rows if x.id == "a") == sorted(places * 2) and [x.content for x in rows if x.id is None] == ["z"]


def test_long_texts_in_several_batches_and_empty_tables(spark):
    text = "many words make a long text " * 40_000
    df = spark.createDataFrame([(1, text), (2, "end")], "id long, text string")
    assert T.token_chunks(df.limit(0), PATH, PATTERN, "id").count() == 0
    rows = T.token_chunks(df, PATH, PATTERN, "id", "text", 700, 630).select("id", "start_token", "end_token", "start_char", "end_char").collect()
    n = len(library().encode_ordinary(text))
    mine = sorted(r for r in rows if r.id == 1)
    assert sum(r.end_char - r.start_char for r in mine) > 2 * T.FLUSH
    assert [(r.start_token, r.end_token) for r in mine] == list(T.windows(n, 700, 630)) and mine[-1].end_token == n
    assert [tuple(r)[1:] for r in rows if r.id == 2] == [(0, 1, 0, 3)]
    with pytest.raises(ValueError):
        T.token_chunks(df, PATH, PATTERN, "id", size=0)


def test_query_takes_whole_texts(spark, tmp_path):
    texts = {1: "word " * 3000, 2: None, 3: "é" * 2500}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ends = {}
    for r in plan.token_chunks(spark, str(tmp_path)).collect():
        ends[r.doc_id] = max(ends.get(r.doc_id, 0), r.end_token)
    enc = library()
    assert ends == {k: len(enc.encode_ordinary(t)) for k, t in texts.items() if t}
