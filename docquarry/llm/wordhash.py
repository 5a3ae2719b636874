"""Vectorised 64-bit hashes of words and of word n-grams over Arrow text columns.

Words are maximal runs of bytes other than space and \\t..\\r, with A-Z lower-cased. A word's hash is a
polynomial in a fixed odd base over random byte values, taken from prefix sums modulo 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from docquarry.llm.base import bytes_of

_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_EXACT = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        made = []
        for base in (_BASE, _BACK):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the rows' words)."""
    (h,), off = word_prefixes(texts, _SPACE, (0,))
    return h, off


#: All of ASCII but letters and digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_prefixes(texts: pa.Array, outside: np.ndarray, lengths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length n, the hash of each word's first n bytes (0: the word); words lie between bytes of outside."""
    data, off = bytes_of(texts)
    n = len(data)
    if not n:
        return [np.zeros(0, np.uint64) for _ in lengths], np.zeros(len(off), np.int64)
    power, back = _tables(n)
    inside = ~outside[data]
    fresh = np.zeros(n + 1, bool)
    fresh[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | fresh[1:n]
    start = np.flatnonzero(begin)
    close = inside.copy()
    close[:-1] &= ~inside[1:] | fresh[1:n]
    end = np.flatnonzero(close) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:n], out=total[1:])
    found = []
    for length in lengths:
        stop = np.minimum(start + length, end) if length else end
        found.append(mix((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64)))
    return found, np.searchsorted(start, off)


def row_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's whole bytes."""
    data, off = bytes_of(texts)
    n = len(data)
    power, back = _tables(n)
    size = np.diff(off).astype(np.uint64)
    out = []
    for value in (_EXACT, _EXACT[::-1]):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value[data] * power[:n], out=total[1:])
        out.append(mix((total[off[1:]] - total[off[:-1]]) * back[off[:-1]] + size))
    return out[0], out[1]


def ngrams(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-word run within a row, offsets of the rows' runs). Rows under k words have none."""
    count = np.maximum(np.diff(off) - k + 1, 0)
    out = np.concatenate(([0], np.cumsum(count))).astype(np.int64)
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    m = len(h) - k + 1
    g = h[:m].copy()
    for i in range(1, k):
        g = g * _STEP + h[i : i + m]
    at = np.repeat(off[:-1] - out[:-1], count) + np.arange(out[-1])
    return mix(g[at]), out


def whole(h: np.ndarray) -> np.uint64:
    """One hash for a short row's whole word sequence."""
    g = np.uint64(len(h))
    for x in h:
        g = np.uint64((int(g) * int(_STEP) + int(x)) & (2**64 - 1))
    return mix(np.array([g], np.uint64))[0]


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer than k words: the whole sequence; none: empty."""
    h, off = words(texts)
    g, at = ngrams(h, off, k)
    out = []
    for i in range(len(off) - 1):
        if at[i + 1] > at[i]:
            out.append(np.unique(g[at[i] : at[i + 1]]))
        elif off[i + 1] > off[i]:
            out.append(np.array([whole(h[off[i] : off[i + 1]])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
