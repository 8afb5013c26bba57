"""Vectorised word and shingle hashing over Arrow string arrays (numpy, no per-word Python)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BYTE_CODE = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Bytes of text hashed at once; bounds the working memory of a task.
BLOCK_BYTES = 1 << 19


def release() -> None:
    """Give freed memory back to the system; Python workers live on after a task and would keep it. Without glibc's
    call only Arrow's own pool is emptied."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse, grown by doubling as longer blocks come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        while self.up.size < n:
            step = _U(pow(_BASE, self.up.size, 1 << 64)), _U(pow(_BASE_INV, self.up.size, 1 << 64))
            self.up, self.down = np.concatenate([self.up, self.up * step[0]]), np.concatenate([self.down, self.down * step[1]])


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base, and of its inverse, modulo 2**64."""
    _POWERS.grow(n)
    return _POWERS.up[:n], _POWERS.down[:n]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``limit`` bytes; a longer single text is a slice of its own."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)
    ends = ends[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int32)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and where each begins (one more entry: the end). Null: empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int32 if pa.types.is_string(texts.type) else np.int64
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and, per text, where its words begin (plus the end). is_word: the bytes of words,
    by default ``[^\\x20\\x09-\\x0D]``."""
    inside = np.zeros(data.size + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    begins = inside[1:-1] & ~inside[:-2]
    first = offsets[:-1][offsets[:-1] < data.size]
    begins[first] = inside[1:-1][first]
    stops = inside[1:-1] & ~inside[2:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = inside[1:-1][last]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    up, down = powers(data.size)
    sums = np.zeros(data.size + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[_LOWER[data]] * up, out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] ^ (end - start).astype(np.uint64))


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles (repeats included), text after text, and where each text's begin (plus the end).
    A text of fewer than n words has its whole word sequence as the only one; a text without words has none."""
    data, offsets = text_bytes(texts)
    start, end, at = word_spans(data, offsets)
    words = word_hashes(data, start, end)
    counts = np.diff(at)
    many = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(int(to[-1]), dtype=np.uint64)
    if words.size >= n:
        rolled = words[: words.size - n + 1].copy()
        for k in range(1, n):
            rolled = mix64(rolled * _U(_BASE) + words[k : words.size - n + 1 + k])
        full = counts >= n
        pick = np.repeat(at[:-1][full] - to[:-1][full], many[full]) + np.flatnonzero(np.repeat(full, many))
        out[np.repeat(full, many)] = rolled[pick]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        h = words[at[i] : at[i] + 1]
        for k in range(1, counts[i]):
            h = mix64(h * _U(_BASE) + words[at[i] + k : at[i] + k + 1])
        out[to[i]] = mix64(h ^ _U(counts[i]))[0]
    return out, to


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingles(), but each text's are sorted and distinct."""
    flat, at = shingles(texts, n)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    for i in range(len(texts)):
        flat[at[i] : at[i + 1]].sort()
    keep = np.ones(flat.size, dtype=bool)
    keep[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))]).astype(np.int64)
