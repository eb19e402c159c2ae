"""Words of UTF-8 text as arrays of 64-bit names, a block of documents at a time.

A word is a run of ASCII digits, ASCII letters (A-Z lower-cased) and bytes of
non-ASCII characters.  All arithmetic wraps modulo 2**64."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SEGMENT = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers["up"]) < n:
        m = max(n, 1 << 20)
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of ``x``, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(name, start, end, row)`` of every word of the rows ``data[off[i]:off[i + 1]]``, in order."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    inside = IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, "right") - 1
    return span_names(data, start, end)[0], start, end, row


def span_names(data: np.ndarray, start: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """Names of the spans from ``start`` (rising) to each of ``ends`` (the first of which is rising and the largest)."""
    names = [np.empty(len(start), np.uint64) for _ in ends]
    i = 0
    while i < len(start):  # segments keep the tables and sums small; a span is never cut
        j = max(i + 1, int(np.searchsorted(ends[0], start[i] + _SEGMENT, "right")))
        a, z = int(start[i]), int(ends[0][j - 1])
        up, down = _tables(z - a)
        total = np.zeros(z - a + 1, np.uint64)
        np.cumsum(_VALUE[LOWER[data[a:z]]] * up[:z - a], out=total[1:])
        s = start[i:j] - a
        for name, end in zip(names, ends, strict=True):
            e = end[i:j] - a
            name[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return [mix(x) for x in names]


def windows(name: np.ndarray, n: int) -> np.ndarray:
    """Names of all runs of ``n`` consecutive words (also of those that cross rows)."""
    m = len(name) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = name[:m].copy()
    for k in range(1, n):
        out *= _STEP
        out += name[k:k + m]
    return mix(out)
