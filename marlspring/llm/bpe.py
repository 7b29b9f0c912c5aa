"""Operator 8: byte-level BPE encoding and decoding by batched numpy merge rounds.

A task cuts its texts into pieces at single spaces, cuts each *distinct* piece into the tokenizer's
pre-tokens, and merges all new pre-tokens together: their symbols lie in one flat array, the rank of
every adjacent pair is found by binary search over the sorted pair keys, and in each round every word
merges the occurrences of its own lowest-ranked pair. A merged symbol only occurs in pairs of higher
rank, so a round may merge all occurrences of one pair. Words of over ``LONG_WORD`` bytes, which would take
very many rounds, are merged from a heap instead. Encoded pieces stay in a cache of the Python worker that is bounded
by bytes, long ones never; a tokenizer that cuts texts otherwise than by the byte-level pattern is refused; nothing but (id, counts, digests or ids) leaves a task, and there is no shuffle.

Defined results: a null or empty text has no tokens (digests of the empty string); very long texts
and words are merged whole; repeated rows give repeated rows; an empty table gives no rows; extra
columns are ignored. The special token's string in a text becomes its one id, as in the library.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marlspring.llm.common import lean, slices, text_of

#: The pre-tokenizer of byte-level BPE vocabularies, as published with them.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that a worker's cache holds before it starts anew, and characters from which on a piece is not kept.
CACHE_BYTES, LONG_PIECE = 128 << 20, 256
#: Bytes of a word from which on its merges are found with a heap: rounds over a flat array are many for such words.
LONG_WORD = 2000
NONE = np.iinfo(np.int64).max


#: Marks that never join a following pre-token, and white space other than the space.
_MARKS = tuple(".,;:!?")
_OTHER_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


_PRE = regex.compile(PRE_TOKEN)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


def crowded(text: str) -> bool:
    """Whether white space stands beside a space."""
    return "  " in text or any(c in text and (" " + c in text or c + " " in text) for c in _OTHER_SPACE)


def pieces(text: str) -> list[str]:
    """Runs of the text whose pre-tokens don't depend on each other: cut before single spaces.

    White space beside a space would be cut differently, so such a run stays in one piece.
    """
    if not text:
        return []
    parts = [" " + p for p in text.split(" ")]
    parts[0] = parts[0][1:]
    if crowded(text):
        joined = [parts[0]]
        for p in parts[1:]:
            if len(p) == 1 or p[1].isspace() or not joined[-1] or joined[-1][-1].isspace():
                joined[-1] += p
            else:
                joined.append(p)
        parts = joined
    return parts if parts[0] else parts[1:]


def pre_tokens(piece: str) -> list[str]:
    """The pre-tokens of a piece; a run of letters, with or without a mark behind it, needs no pattern."""
    body = piece[1:] if piece[0] == " " else piece
    if body.isalpha():
        return [piece]
    if body[-1:] in _MARKS and body[:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return _PRE.findall(piece)


def plain_byte_level(spec: dict) -> bool:
    """Whether a ``tokenizer.json`` cuts texts by the byte-level pattern alone."""
    cut = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)


def check_pre_tokenizer(spec: dict) -> None:
    if not plain_byte_level(spec):
        raise ValueError(f"pre-tokenizer or normalizer is not the plain byte-level one: {spec.get('pre_tokenizer')}")


class Bpe:
    """Vocabulary, merges and added tokens of a byte-level ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_pre_tokenizer(spec)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.first = np.array([vocab[s] for s in symbols], dtype=np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.text_of = list(map(str, range(self.size)))
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.held = 0
        self.once: dict[str, tuple[str, int, bytes]] = {}  # long pieces of the texts at hand
        self.pairs: dict[int, tuple[int, int]] = {}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (not empty) one after another, and the words' offsets; by rounds over one flat array."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NONE)
            rank = np.append(rank, NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(sym)))
            own = np.repeat(least, counts)
            ended = own == NONE
            if ended.any():  # words without a pair leave the array
                done_sym.append(sym[ended])
                done_word.append(word[ended])
                keep = ~ended
                sym, word, rank, own = sym[keep], word[keep], rank[keep], own[keep]
                at = np.append(at, 0)[keep]
                if not len(sym):
                    break
            else:
                at = np.append(at, 0)
            hit = np.flatnonzero(rank == own)
            if len(hit) > 1:  # of overlapping occurrences (aaa), every second one of the run
                new = np.append(True, np.diff(hit) != 1)
                begin = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")], np.append(0, np.cumsum(np.bincount(word, minlength=len(words))))

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of one long word: the same merges, the lowest rank and leftmost place first, from a heap."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        sym = self.first[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, pairs, size = len(sym), self.pairs, self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[k][0], i) for i in range(n - 1) if (k := sym[i] * size + sym[i + 1]) in pairs]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            got = pairs.get(sym[i] * size + sym[j]) if sym[i] >= 0 and j < n else None
            if got is None or got[0] != rank:
                continue  # one of the two was merged before
            sym[i], sym[j] = got[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := sym[i] * size + sym[k]) in pairs:
                    heappush(heap, (pairs[pair][0], i))
            p = before[i]
            if p >= 0 and (pair := sym[p] * size + sym[i]) in pairs:
                heappush(heap, (pairs[pair][0], p))
        return [s for s in sym if s >= 0]

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge``, with long words merged by themselves."""
        long = {i: self.merge_long(w) for i, w in enumerate(words) if len(w) > LONG_WORD}
        ids, ends = self.merge([w for i, w in enumerate(words) if i not in long])
        if not long:
            return ids, ends
        short = iter(np.split(ids, ends[1:-1]) if len(ends) > 1 else [])
        every = [np.array(long[i]) if i in long else next(short) for i in range(len(words))]
        return np.concatenate(every), np.append(0, np.cumsum([len(e) for e in every]))

    def _learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that the cache lacks, all in one batch; long ones are kept for these texts only."""
        self.once = {}
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        new = [p for p in pieces if p not in self.cache]
        if not new:
            return
        cut = list(map(pre_tokens, new))
        place: dict[str, int] = {}
        parts = np.fromiter((place.setdefault(w, len(place)) for w in chain.from_iterable(cut)), dtype=np.int64)
        ids, ends = self._merged([w.encode() for w in place])
        n_parts = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        size = np.diff(ends)[parts]
        stop = np.cumsum(size)
        flat = ids[np.arange(stop[-1]) - np.repeat(stop - size, size) + np.repeat(ends[parts], size)].tolist()
        text, raw = list(map(self.text_of.__getitem__, flat)), list(map(self.bytes_of.__getitem__, flat))
        at = 0
        for piece, to in zip(new, stop[np.cumsum(n_parts) - 1].tolist()):
            told = (",".join(text[at:to]), to - at, b"".join(raw[at:to]))
            at = to
            if len(piece) > LONG_PIECE:
                self.once[piece] = told
            else:
                self.cache[piece] = told
                self.held += 250 + 2 * len(piece) + len(told[0]) + len(told[2])

    def encode(self, texts: list[str | None]) -> Iterator[list[tuple[str, int, bytes]]]:
        """For each text, its encoded runs: (ids as text, number of ids, decoded bytes)."""
        cut = [pieces(t or "") for t in texts if not self._has_special(t)]
        runs_of = [self.at_special.split(t) for t in texts if self._has_special(t)]
        special = [[[r] if k % 2 else pieces(r) for k, r in enumerate(runs)] for runs in runs_of]
        self._learn(set(chain.from_iterable([*cut, *(run for runs in special for run in runs[::2])])))
        fixed = {s: (str(i), 1, s.encode()) for s, i in self.special.items()}
        held, once = self.cache, self.once
        get = (lambda p: held[p] if p in held else once[p]) if once else held.__getitem__
        plain, special = iter(cut), iter(special)
        for t in texts:
            if self._has_special(t):
                yield list(chain.from_iterable([fixed[run[0]]] if k % 2 else map(get, run) for k, run in enumerate(next(special))))
            else:
                yield list(map(get, next(plain)))

    def _has_special(self, text: str | None) -> bool:
        return bool(text) and any(s in text for s in self.special)


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The tokenizer at a path that every executor has; a worker loads it once."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def bpe_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for enc in bpe.encode(part.column(1).to_pylist()):
                    ids, n, raw = zip(*enc) if enc else ((), (), ())
                    rows.append((sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(raw).decode("utf-8", "replace").encode()).hexdigest()))
                n, ids, dec = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the token ids of every whole text, as an array."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [[int(i) for e in enc if e[0] for i in e[0].split(",")] for enc in bpe.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return text_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each array of ids; a null array gives a null text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = load(tokenizer_path).bytes_of
        for batch in batches:
            texts = [None if ids is None else b"".join([names[i] for i in ids]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("doc_id", f"`{ids_col}` AS ids").mapInArrow(run, "doc_id long, text string")
