"""64-bit hashes of words and of runs of words, over whole slices of texts at once."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a uint64 over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; kept for the largest n so far."""
    size = max(_POWERS, default=0)
    if size < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_ODD, -1, 1 << 64)
        up, down = np.full(size, _ODD, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts in which only spaces part words, and the words' offsets by text."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    up, down = powers(len(raw) + 1)
    blank = raw == 32
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank))))
    start, end = edge[::2], edge[1::2]
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(raw * up[: len(raw)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(start, begins)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words, from each position on; shorter by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out *= np.uint64(0x100000001B3)
        out ^= hashes[j : j + n]
        out = (out << np.uint64(23)) | (out >> np.uint64(41))
    return mix(out)
