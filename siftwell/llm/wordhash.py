"""Hashes of words and of word windows, vectorised over the texts of a UTF-8 buffer.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  A run's hash is the polynomial of
its bytes modulo 2**64, taken from prefix sums and multiplied back by inverse powers, then mixed;
a window's hash is the same over its words' hashes, in two lanes of different bases (128 bits).
"""

from __future__ import annotations

import numpy as np

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Random odd bases: of bytes, and of the two lanes of words.
BYTE_BASE, LANE_BASES = 0xC2B2AE3D27D4EB4F, (0x9FB21C651E98DF25, 0xA0761D6478BD642F)
BLOCK = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base ** i, base ** -i) modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        found = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            found.append(np.cumprod(table, dtype=np.uint64))
        _powers[base] = found[0], found[1]
    up, down = _powers[base]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial hashes of ``values[start:end]`` (uint64)."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(array: np.ndarray, ends: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end byte of every word, each text's first word number with the total at the end)."""
    inside = np.zeros(len(array) + 1, bool)
    np.logical_not(is_space[array], out=inside[:-1])
    before = np.zeros(len(array) + 1, bool)
    before[1:] = inside[:-1]
    fresh = np.zeros(len(array) + 1, bool)
    fresh[ends] = True
    starts = np.flatnonzero(inside & (fresh | ~before))
    stops = np.flatnonzero(before & (fresh | ~inside))
    return starts, stops, np.searchsorted(starts, ends)


def word_hashes(array: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in blocks of words so that the tables stay small."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(stops, first + BLOCK, side="right")))
        last = int(stops[to - 1])
        out[at:to] = runs(array[first:last].astype(np.uint64), starts[at:to] - first, stops[at:to] - first, BYTE_BASE)
        at = to
    return out


def windows(hashes: np.ndarray, first: np.ndarray, width: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers at which a window of ``width`` words of one text starts, hashes there)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lengths = np.diff(first)
    room = np.maximum(lengths - width + 1, 0)
    ends = np.cumsum(room)
    at = np.repeat(first[:-1] - ends + room, room) + np.arange(ends[-1])
    return at, runs(hashes, at, at + width, LANE_BASES[lane])
