"""Small numpy helpers that several operators share: byte views of Arrow text, word bounds, hashes.

All hashing is by position-weighted sums modulo 2**64, so that the hash of any span of a buffer is a
difference of two prefix sums and a whole batch is hashed without a Python loop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random value for each byte, and for each byte after lower-casing A-Z.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for the bytes of the class [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(BASE), -1, 2**64))
_powers = {"p": np.ones(1, U), "i": np.ones(1, U)}
#: Multipliers that make a shingle's hash depend on the order of its words.
STEP = _rng.integers(1, 2**63, 16, dtype=np.int64).astype(U) * U(2) + U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0..n-1 and their inverses, kept between calls."""
    if len(_powers["p"]) < n:
        m = max(n, 1 << 16)
        for k, b in (("p", BASE), ("i", _INVERSE)):
            a = np.full(m, b, U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = h.astype(U, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary column as one byte array and its row offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges (lo, hi) of about limit bytes, one row at least; bounds what numpy holds at once."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs outside [\\x20\\x09-\\x0D]) and each row's first word (rows + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    starts = np.flatnonzero(word & (before | first[:-1]))
    ends = np.flatnonzero(word & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Spans:
    """Hashes of byte spans of one buffer in constant time each."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        self.p, self.i = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((BYTE[LOWER] if lower else BYTE)[data] * self.p[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.i[start] + (end - start).astype(U))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one document's word hashes; the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return np.zeros(0, U)
    m = min(n, k)
    h = np.zeros(n - m + 1, U)
    for j in range(m):
        h += words[j : n - m + 1 + j] * STEP[j]
    return mix(h + U(m))
