"""Splitting UTF-8 bytes into words or tokenizer units and hashing them, in NumPy over whole slices."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        step = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hash of every span: a polynomial over the bytes from prefix sums, then mixed."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power("up", n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", n + 1)[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than the six ASCII white-space bytes, never across rows: (starts, ends, first word of each row).

    The third array has one entry more than rows.
    """
    solid = ~WHITE[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[inner] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(word_hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words inside a row, and the first shingle of each row (one entry more than rows).

    A row with fewer words (but one at least) has its whole sequence as the only shingle.
    """
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(int(bounds[-1]), np.uint64)
    whole = counts >= width
    if whole.any():
        at = np.repeat(first[:-1][whole] - np.concatenate([[0], np.cumsum(made[whole])[:-1]]), made[whole]) + np.arange(int(made[whole].sum()))
        h = np.zeros(len(at), np.uint64)
        for i in range(width):
            h = mix(h + word_hashes[at + i] + np.uint64(i + 1))
        out[np.repeat(whole, made)] = h
    for row in np.flatnonzero((counts > 0) & ~whole):
        h = np.zeros(1, np.uint64)
        for i, w in enumerate(word_hashes[first[row]:first[row + 1]]):
            h = mix(h + w + np.uint64(i + 1))
        out[bounds[row]] = mix(h + np.uint64(1000 + counts[row]))[0]
    return out, bounds


def distinct_sorted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row of a ragged array, and the new bounds."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.concatenate([[0], np.cumsum(np.bincount(r[keep], minlength=len(bounds) - 1))])
