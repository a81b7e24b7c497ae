"""Vectorised text primitives that run inside Arrow workers.

A *word* is a maximal run of ASCII letters or digits or of any non-ASCII
characters, after lower-casing (as a regular expression:
``[0-9a-z\\u0080-\\U0010ffff]+``).  Words are hashed to 64 bits with a
polynomial over their UTF-8 bytes, computed for a whole piece of many documents
at once from prefix sums, so no Python object is made per word.

Texts are taken in pieces of about :data:`PIECE_BYTES`; a document is never
split, so a longer one forms a piece by itself.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 17

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, size=256, dtype=np.uint64)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least; the longest tables made so far are kept."""
    size = max(_powers, default=0)
    if size < n:
        size = max(2 * PIECE_BYTES, 1 << int(n).bit_length())
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _powers.clear()
        _powers[size] = (up, down)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (in place where the array allows it)."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def as_text(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A null-free large_string array; nulls become empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], type=pa.large_string())
    arr = arr.cast(pa.large_string())
    return pc.fill_null(arr, "") if arr.null_count else arr


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets (length n + 1, from 0) of a large_string array."""
    n = len(arr)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    data = arr.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(arr: pa.Array, limit: int = 0) -> Iterator[tuple[int, pa.Array]]:
    """(index of its first document, slice) with about ``limit`` bytes each."""
    limit = limit or PIECE_BYTES
    _, off = raw(arr)
    i, n = 0, len(arr)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, arr.slice(i, j - i)
        i = j


def release() -> None:
    """Give free memory back to the system: a worker lives on for other tasks."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task``, after which memory is released."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release()

    return run


class Words:
    """The words of a piece: byte spans, hashes, and each document's range of words."""

    __slots__ = ("starts", "ends", "hashes", "first")

    def __init__(self, arr: pa.Array, lower: bool = True):
        b, off = raw(pc.utf8_lower(arr) if lower else arr)
        n = len(b)
        w = _IS_WORD[b]
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        start = w.copy()
        start[1:] &= ~w[:-1] | edge[1:n]
        end = w.copy()
        end[:-1] &= ~w[1:] | edge[1:n]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.hashes = span_hashes(b, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, off)


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[b] * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of ``n`` words of ONE document; a shorter document has one shingle, its whole word sequence."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _U(_BASE)
        out ^= out >> _U(29)
    return mix(out + _U(n))


def hash_word(word: str) -> int:
    """The hash of one word, as :class:`Words` gives it."""
    b = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0]) if len(b) else 0
