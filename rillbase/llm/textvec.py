"""Word and shingle hashing over whole Arrow text columns, in numpy, without a Python object per word."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_power = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of the two word rules: white space only, and everything in ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _power["n"] < n:
        size = max(n, 2 * _power["n"], 1 << 16)
        for key, r in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _power[key] = np.cumprod(p)
        _power["n"] = size
    return _power["up"], _power["down"]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words of each document; none crosses documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    gap = separators[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    inner = offsets[1:-1]
    before[inner[inner < n]] = True
    after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running sum over the buffer."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(word: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows (the whole sequence of a shorter document, none without words) and their number per document."""
    n, per = len(word), np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc = mix(acc + word[j : n - k + 1 + j] * np.uint64((2 * j + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        out[: n - k + 1] = acc
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        acc = np.full(1, 0x51ED270B0A1F39C1 + int(counts[d]), np.uint64)
        for w in word[first[d] : first[d] + counts[d]]:
            acc = mix(acc * np.uint64(0xC2B2AE3D27D4EB4F) + w)
        out[first[d]] = acc[0]
    at = np.repeat(first - (np.cumsum(per) - per), per) + np.arange(per.sum())
    return out[at], per
