"""Operator 9: token ids in Parquet list columns that can be read selectively.

Documents are dealt out by ranges of doc_id and sorted within each; a task encodes its range in order
and writes (part, start_in_part, doc_id, n_tokens, ids). The ids are dictionary-encoded list values;
row groups and pages have controlled sizes, and as doc_id ascends through a file, its page index lets
a reader fetch the pages of a few documents only, or the metadata columns without the ids. Positions
across files come from one sum for each part, so no task ever sees more than its own range.

Defined results: a null or empty text gives only the end id; rows that repeat a doc_id are documents
of their own, in the order of their texts' hashes (equal ones in any order); a null doc_id sorts first; an
empty table writes no document; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspring.llm.bpe import LONG_PIECE, byte_symbols, crowded, pieces, plain_byte_level, pre_tokens
from marlspring.llm.common import environment, slices, text_of

SCHEMA = "part int, start_in_part long, doc_id long, n_tokens long, ids array<int>"
#: Bytes of pieces with their ids in one generation of a worker's cache: it holds two generations of pieces behind a space and of others.
CACHE_BYTES = 72 << 20
#: Bytes of texts whose distinct words are looked up together.
SLICE_BYTES = 6_000_000
#: Characters of pre-tokens that are kept apart from pieces, and how many of them a worker keeps.
SHORT, SHORT_WORDS = 4, 50_000


class _Pieces(dict):
    """Ids (as bytes) of pieces that follow a space (``before`` = " ") or nothing, by the library's model.

    Kept in two generations: when the younger one is full it becomes the older, and what is still used moves
    back, so frequent pieces stay and a long tail of rare ones goes. Long pieces are never kept.
    """

    def __init__(self, model, before: str):
        self.model, self.before = model, before
        symbols = byte_symbols()
        self.symbols, self.start = str.maketrans(dict(enumerate(symbols))), "".join(symbols[b] for b in before.encode())
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece) or self._made(piece)
        if len(piece) <= LONG_PIECE:
            if self.held > CACHE_BYTES:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = got
            self.held += 200 + len(piece) + len(got)
        return got

    def _made(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():  # letters stand for themselves
            return self._ids(self.start + piece)
        text = self.before + piece
        if not text:
            return b""
        head, *rest = pre_tokens(text)
        if not rest:
            return self._word(head)
        # The word before a mark is a piece of its own.
        own = self[head[1:]] if self.before and len(head) > 1 else self._part(head)
        return own + (self._part(rest[0]) if len(rest) == 1 else b"".join(map(self._part, rest)))

    def _part(self, word: str) -> bytes:
        """As ``_word``; what is of a few characters, such as marks and syllables, recurs and is kept."""
        if len(word) > SHORT:
            return self._word(word)
        got = self.parts.get(word)
        if got is None:
            if len(self.parts) > SHORT_WORDS:
                self.parts.clear()
            got = self.parts[word] = self._word(word)
        return got

    def _word(self, word: str) -> bytes:
        return self._ids(word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.symbols))

    def _ids(self, symbols: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()


class LibraryEncoder:
    """The tokenizers library over distinct pieces of texts, whose ids a worker keeps (bounded).

    A text is cut into pre-tokens by the byte-level pattern; the library's model encodes each distinct one.
    Where the file names another pattern or a normalizer, or a text holds a special token, the library encodes
    the whole text itself.
    """

    def __init__(self, path: str):
        environment()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.plain = plain_byte_level(json.load(f))
        self.spaced, self.first = _Pieces(self.tokenizer.model, " "), _Pieces(self.tokenizer.model, "")

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        n, ids = self.encode_column(pa.array(texts, pa.string()))
        raw, at = ids.tobytes(), 0
        for k in n.tolist():
            yield raw[at : at + 4 * k]
            at += 4 * k

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all their ids in order, with ``end`` after each text.

        Arrow cuts the texts at spaces and finds the distinct words, so that only these are looked up; the ids of all words
        are then gathered by their places.
        """
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        strings = texts.to_numpy(zero_copy_only=False).tolist()
        whole = {i: self._whole(t) for i, t in enumerate(strings) if self._apart(t)}
        if whole:
            texts = pa.array(["" if i in whole else t for i, t in enumerate(strings)], pa.string())
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        words = cut.flatten()
        heads = words.take(pa.array(offsets[:-1])).to_pylist()
        coded = words.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = coded.indices.to_numpy().copy()
        # A text's first word follows no space; it is an entry of its own, as is the end.
        place[offsets[:-1]] = np.arange(len(known), len(known) + len(heads))
        spaced = self.spaced
        entries = [spaced[w] for w in known]
        entries += [whole[i] if i in whole else self.first[w] for i, w in enumerate(heads)]
        entries.append(end)
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) >> 2
        place = np.insert(place, offsets[1:], len(entries) - 1)
        ends = np.append(0, np.cumsum(sizes[place]))
        n = np.diff(ends[offsets + np.arange(len(offsets))])
        starts = np.append(0, np.cumsum(sizes))[:-1]
        # Where the ids of a word lie among those of all entries, counted on from where they go.
        source = np.repeat((starts[place] - ends[:-1]).astype(np.int32), sizes[place])
        source += np.arange(ends[-1], dtype=np.int32)
        return n, np.frombuffer(b"".join(entries), "<u4")[source]

    def _apart(self, text: str) -> bool:
        """Whether words can't be encoded one by one."""
        return bool(text) and (not self.plain or any(s in text for s in self.specials) or crowded(text))

    def _whole(self, text: str) -> bytes:
        if not self.plain or any(s in text for s in self.specials):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        head, *rest = pieces(text)
        # Every later piece begins with the space it was cut before.
        return self.first[head] + b"".join([self.spaced[p[1:]] for p in rest])


_LOADED: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, row_group_mb: int = 16, page_kb: int = 256) -> None:
    """Encodes every whole text, appends the end id and writes the files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start, end = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                n, values = encoder.encode_column(rows.column(1), end)
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), rows.column(0), pa.array(n), ids], ["part", "start_in_part", "doc_id", "n_tokens", "ids"])
                start += int(ends[-1])

    # The range bounds are sampled from the keys, so no text is one of them.
    ordered = text_of(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    (
        ordered.mapInArrow(run, SCHEMA)
        .write.option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.size", page_kb << 10)
        .option("parquet.page.write-checksum.enabled", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; filters on doc_id reach the page index."""
    files = spark.read.schema(SCHEMA).parquet(path)
    # One row for each part: the running sum over them is small at every size.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def token_crc(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
