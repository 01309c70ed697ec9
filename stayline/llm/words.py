"""Vectorised cutting and hashing of the words of many texts at once.

All texts of a slice lie one after the other in one byte buffer. A word hash is
a polynomial over its bytes modulo 2**64 (taken from prefix sums, so it costs a
few numpy passes for the whole slice), mixed to spread its bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed together; pieces end at a cut, so only a longer single word makes a longer piece.
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ALNUM = np.zeros(256, bool)
ALNUM[128:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    ALNUM[ord(_a) : ord(_b) + 1] = True
#: Folds A-Z only; other letters stay as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE) + 1
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.cumprod(out, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(offsets) else whole[:0], offsets - offsets[0]


def cut_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of bytes for which `inside` holds; no run crosses rows."""
    on = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], on[:-1])) & ~edge[:-1]
    after = np.concatenate((on[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(on & ~before)
    ends = np.flatnonzero(on & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that are sorted and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + PIECE, "right")))
        size = int(ends[last - 1] - origin)
        up, down = _powers(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[origin : origin + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        a, b = starts[first:last] - origin, ends[first:last] - origin
        out[first:last] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        first = last
    return mix(out)


def row_bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row begins in an array sorted by row; n_rows + 1 entries."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def word_hashes(column: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, A-Z folded, and where each row begins."""
    data, offsets = buffer_of(column)
    starts, ends, rows = cut_words(data, offsets, inside)
    return hash_spans(FOLD[data], starts, ends), row_bounds(rows, len(column))
