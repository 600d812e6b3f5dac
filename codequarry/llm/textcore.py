"""Vectorised text primitives over the flat bytes of an Arrow column: words, hashes, shingles, minima.

All functions work on whole batches with numpy, never on single rows, and give the same hash for the same bytes in
every process (no dependence on Python's salted ``hash``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240601))
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: Random value of a byte at each of the first PLACES positions of its span; later positions are mixed in.
PLACES = 32
PLACED = _RNG.integers(0, 2**64, PLACES * 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 row offsets into them, from zero."""
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def runs(inside: np.ndarray, offs: np.ndarray, kind: np.ndarray | None = None):
    """Starts and ends of maximal runs of ``inside`` bytes that never cross a row (nor, with ``kind``, a change of it)."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offs[offs <= n]] = True
    if kind is not None:
        cut[1:n] |= kind[1:] != kind[:-1]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (spans ascend and don't overlap).

    A byte counts as a random value of itself and its place in the span, so unlike a polynomial modulo 2**64 no arrangement of bytes
    cancels out. Callers that must not confuse two spans still compare their bytes.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    at = np.arange(len(data), dtype=np.int32)
    if len(data) != int(size.sum()):
        at = at[_covered(len(data), starts, ends)]
    bytes_ = data[at]
    stops = np.cumsum(size)
    place = np.arange(len(at), dtype=np.int32) - np.repeat((stops - size).astype(np.int32), size)
    with np.errstate(over="ignore"):
        value = PLACED[(np.minimum(place, PLACES - 1) << 8) + bytes_]
        late = np.flatnonzero(place >= PLACES)
        if len(late):
            value[late] = mix(value[late] + place[late].astype(np.uint64) * U(0x9E3779B97F4A7C15))
        total = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        return mix((total[stops] - total[stops - size]) ^ (size.astype(np.uint64) * U(0xD6E8FEB86659FD93)))


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a span."""
    step = np.zeros(n + 1, np.int8)
    full = ends > starts
    step[starts[full]] += 1
    step[ends[full]] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)


def words(col: pa.Array, lower: bool = True):
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of every row and the n + 1 row offsets into them."""
    data, offs = flat(col)
    if lower:
        data = LOWER[data]
    starts, ends = runs(~SPACE[data], offs)
    return span_hash(data, starts, ends), np.searchsorted(starts, offs)


def shingles(h: np.ndarray, offs: np.ndarray, k: int):
    """Distinct hashed k-word shingles of each row, sorted in it, and row offsets.

    A row of one to k - 1 words has its whole sequence as its only shingle; a row without words has none.
    """
    n = np.diff(offs)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_offs = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    first = offs[row] + np.arange(len(row)) - out_offs[row]
    last = offs[row] + n[row]
    with np.errstate(over="ignore"):
        s = np.full(len(row), U(k), np.uint64)
        for j in range(k):
            at = first + j
            there = at < last
            s = np.where(there, mix(s * U(0x9E3779B97F4A7C15) + h[np.minimum(at, max(len(h) - 1, 0))]), s) if len(h) else s
        s = np.where(n[row] < k, mix(s ^ n[row].astype(np.uint64)), s)
    for a, b in zip(out_offs[:-1].tolist(), out_offs[1:].tolist()):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    kept = np.concatenate([[0], np.cumsum(new)])
    return s[new], kept[out_offs]


def digest(s: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each row's set (0 for an empty one)."""
    with np.errstate(over="ignore"):
        total = lambda x: (c := np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]))[offs[1:]] - c[offs[:-1]]
        return mix(total(mix(s * U(3) + U(1)))), mix(total(mix(s ^ U(0xA0761D6478BD642F))) * U(5))


def minima(s: np.ndarray, offs: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(rows, seeds) array: the least value of each seeded hash over each row's set; empty rows get all ones."""
    n = len(offs) - 1
    out = np.full((n, len(seeds)), ~U(0), np.uint64)
    full = np.flatnonzero(np.diff(offs) > 0)
    if not len(full):
        return out
    at = offs[full]
    with np.errstate(over="ignore"):
        for j, seed in enumerate(seeds):
            x = (s ^ seed) * (seed | U(1))
            x ^= x >> U(31)
            out[full, j] = np.minimum.reduceat(x, at)
    return out
