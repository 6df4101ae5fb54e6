"""Words and hashes of whole Arrow text columns, computed column-wise with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the
same as a run of such characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 18
_POWERS = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 2 * _PIECE)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks] or [pa.array([], pa.large_string())])
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; words ``first[i]`` to ``first[i + 1]`` are row i's."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word; ``fold`` maps bytes first (e.g. to lower case)."""
    out = np.empty(len(starts), np.uint64)
    table = _TABLE if fold is None else _TABLE[fold]
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, lo + _PIECE)))
        hi = ends[j - 1]
        power, inverse = _powers(int(hi - lo) + 1)
        total = table[data[lo:hi]]
        total *= power[: hi - lo]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(total)])
        a = starts[i:j] - lo
        out[i:j] = mix((total[ends[i:j] - lo] - total[a]) * inverse[a])
        i = j
    return out


def window_hashes(words: np.ndarray, first: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words that lie in one row, and their first words' places."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.full(m, seed * 2 + 1, np.uint64)
    for k in range(n):
        h *= np.uint64(_BASE)
        h += words[k : k + m]
    last = np.repeat(first[1:], np.diff(first))[:m]
    at = np.flatnonzero(np.arange(m) + n <= last)
    return mix(h[at]), at
