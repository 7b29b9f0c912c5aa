"""Chunks of a set number of a tokenizer's tokens, with their places in the text."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of chunks that a task gathers before it hands them on.
FLUSH = 4_000_000
_COLUMNS = pa.schema([("chunk_index", pa.int64()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("content", pa.string())])


@lru_cache(maxsize=4)
def _tokenizer(path: str, pattern: str):
    """The library's tokenizer of a file of ranks, and the length in bytes of each token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def windows(n: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of windows over n tokens; the last one ends with the last token."""
    start = 0
    while start < n:
        end = min(start + size, n)
        yield start, end
        if end == n:
            return
        start = max(end - overlap, start + 1)


def _cut(text: str, path: str, pattern: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, int, int, str]]:
    encoding, lengths = _tokenizer(path, pattern)
    raw = text.encode()
    ends = np.concatenate([[0], np.cumsum(lengths[np.array(encoding.encode_ordinary(text), np.int64)])])
    begins = np.concatenate([(np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, [True]])  # bytes that begin a character, and the end
    before = np.cumsum(begins) - 1
    k = 0
    for s, e in windows(len(ends) - 1, size, overlap):
        low, high = int(ends[s]), int(ends[e])
        whole = bool(begins[low] and begins[high])
        piece = raw[low:high].decode(errors="replace")
        content = piece.strip()
        if content:
            at = int(before[low]) + len(piece) - len(piece.lstrip()) if whole else -1
            yield k, s, e, at, at + len(content) if whole else -1, content
            k += 1


def token_chunks(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", size: int = 700, overlap: int = 80) -> DataFrame:
    """key, chunk_index, start_token, end_token, start_char, end_char, content: windows of ``size`` tokens, without white space at the ends.

    path is a file of ranks that every task can read, pattern the expression that splits a text before merges. Places come
    from the tokens' bytes, so a chunk has its true place even where it overlaps the one before or where its words occur
    earlier too. No shuffle: a text is cut where it is read, and a task hands chunks on as it makes them.

    Defined results: null and empty texts, and windows of white space only, give no chunk, and the index stays dense; a
    window that begins or ends within a character has places -1 and shows the replacement mark there; special tokens' names
    in a text are ordinary text; an overlap of ``size`` or more moves on by one token; repeated rows repeat their chunks; null keys
    are kept; extra columns are ignored, whatever their names.
    """
    if size < 1 or overlap < 0:
        raise ValueError("the size must be 1 or more, the overlap 0 or more")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out, held, keys = [], 0, []

            def made():
                table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _COLUMNS)], schema=_COLUMNS)
                return table.add_column(0, "_key", batch.column(0).take(pa.array(keys, pa.int64()))).to_batches()

            for i, t in enumerate(batch.column(1)):
                for chunk in _cut(t.as_py() or "", path, pattern, size, overlap):
                    out.append(chunk)
                    keys.append(i)
                    held += len(chunk[-1])
                    if held > FLUSH:
                        yield from made()
                        out, held, keys = [], 0, []
            if out:
                yield from made()

    cut = rows.mapInArrow(run, f"_key {kind}, chunk_index long, start_token long, end_token long, start_char long, end_char long, content string")
    return cut.withColumnRenamed("_key", key)
