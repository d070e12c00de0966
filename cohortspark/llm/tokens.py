"""Token ids of whole texts by the tokenizers library, each distinct piece of text being encoded once for a worker.

Both byte-pair tokenizers cut a text into pre-tokens first and never merge across them. Cutting at places that are always
pre-token borders therefore leaves the ids as they are; the pieces repeat far more often than texts do, so a worker keeps
their ids in sorted arrays and calls the library for new pieces only.
"""

from __future__ import annotations

import os
import zlib

import numpy as np

from cohortspark.llm.common import ragged
from cohortspark.llm.units import WHITE, span_hashes

MEMO_PIECES = 1_000_000
LONG_PIECE = 512                       # bytes; longer pieces are encoded each time
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True
# after these lead bytes a wide white-space character may follow; other bytes over 0x20 start a solid character
_SOLID_NEXT = np.arange(256) > 0x20
_SOLID_NEXT[[0x7F, *range(0x80, 0xC0), 0xC2, 0xE1, 0xE2, 0xE3]] = False
_SOLID_PREV = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)


def piece_borders(data: np.ndarray, offsets: np.ndarray, keeps_space: bool) -> np.ndarray:
    """Starts of pieces (plus the end): every row starts one, and no pre-token crosses a start.

    ``keeps_space``: a single space belongs to the pre-token after it (byte-level pattern). A space with a solid character
    after it always begins a pre-token; a line feed between solid characters is one by itself. Otherwise white space is
    dropped and each white-space byte may be cut on both sides. A letter is never in one pre-token with a stop after it.
    """
    n = len(data)
    start = np.zeros(n + 1, bool)
    start[offsets] = True
    start[n] = True
    if n > 1:
        prev, here = data[:-1], data[1:]
        start[1:n] |= _LETTER[prev] & _STOP[here]
        if keeps_space:
            solid_next = np.zeros(n, bool)
            solid_next[:-1] = _SOLID_NEXT[data[1:]]
            solid_prev = np.zeros(n, bool)
            solid_prev[1:] = _SOLID_PREV[data[:-1]]
            rows = offsets[(offsets > 0) & (offsets < n)]
            solid_next[rows - 1] = False
            solid_prev[rows] = False
            start[:n] |= (data == 0x20) & solid_next
            alone = np.flatnonzero((data == 0x0A) & solid_next & solid_prev)
            start[alone] = True
            start[alone + 1] = True
        else:
            white = np.flatnonzero(WHITE[data])
            start[white] = True
            start[white + 1] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of the rows of a text slice. One object lives in each Python worker (see :func:`encoder`)."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)       # where the ids of a key start
        self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _borders(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return piece_borders(data, offsets, self.keeps_space)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for g in got for i in g), np.uint32, int(size.sum())), size

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds by row)."""
        borders = self._borders(data, offsets)
        starts, ends = borders[:-1], borders[1:]
        if not self.keeps_space:
            solid = ~((ends - starts == 1) & WHITE[data[np.minimum(starts, max(0, len(data) - 1))]]) if len(data) else np.zeros(0, bool)
            starts, ends = starts[solid], ends[solid]
        long_ = ends - starts > LONG_PIECE
        keys, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > MEMO_PIECES:
            self._clear()
        known = np.searchsorted(self.keys, keys)
        hit = (known < len(self.keys)) & (self.keys[np.minimum(known, max(0, len(self.keys) - 1))] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~hit & ~long_[first])
        if len(new):
            raw = data.tobytes()
            ids, size = self._encode([raw[starts[i]:ends[i]].decode() for i in first[new]])
            at = len(self.ids) + np.cumsum(size) - size
            where = known[new]
            self.keys = np.insert(self.keys, where, keys[new])
            self.at = np.insert(self.at, where, at)
            self.size = np.insert(self.size, where, size)
            self.ids = np.concatenate([self.ids, ids])
        slot = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))[inverse]
        pool, at, size = self.ids, (self.at[slot] if len(self.at) else np.zeros(len(slot), np.int64)), (self.size[slot] if len(self.size) else np.zeros(len(slot), np.int64))
        if long_.any():
            raw = data.tobytes()
            which = np.flatnonzero(long_)
            ids, sizes = self._encode([raw[starts[i]:ends[i]].decode() for i in which])
            at[which], size[which] = len(pool) + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate([pool, ids])
        piece_row = np.searchsorted(offsets, starts, "right") - 1
        per_row = np.bincount(piece_row, weights=size, minlength=len(offsets) - 1).astype(np.int64) if len(starts) else np.zeros(len(offsets) - 1, np.int64)
        return pool[ragged(at, size)], np.concatenate([[0], np.cumsum(per_row)])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool) -> Encoder:
    if (path, keeps_space) not in _encoders:
        _encoders[path, keeps_space] = Encoder(path, keeps_space)
    return _encoders[path, keeps_space]


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
