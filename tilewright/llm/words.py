"""Vectorised words, n-grams and hashes over Arrow batches of text.

A worker sees a batch as one flat UTF-8 byte array plus row offsets and works on it in slices of about
``CHUNK`` bytes, so memory stays bounded whatever the batch holds; a row longer than that is a slice by itself.
Words are ``[^\\x20\\x09-\\x0D]+`` unless said otherwise. Hashes are 64-bit: a word's bytes are mixed in eight at a time,
and those of long words come from BLAKE2b. Where a collision would give a wrong result, callers compare the bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of more bytes than this are hashed one by one with BLAKE2b.
LONG = 64

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (SplitMix64's output function, a public constant set)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK * 2)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _powers = (up, down)
        if n > CHUNK * 4:  # one giant row: do not keep its tables
            _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
        return up, down
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of ``data[starts[i]:ends[i]]`` for each i; equal bytes, equal hash.

    Eight bytes at a time are mixed into the state, for all spans at once; hashes of other seeds are independent. Long
    spans go through BLAKE2b, keyed with the seed, so work stays in proportion to the bytes."""
    size = ends - starts
    padded = np.concatenate([np.ascontiguousarray(data), np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = mix(size.astype(np.uint64) + mix(np.array([(seed * _BASE + 1) & _MASK], np.uint64)))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(live):
        left = size[live] - at
        lane = lanes[starts[live] + at]
        short = left < 8
        lane[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix(out[live] * np.uint64(_BASE) ^ lane)
        at += 8
        live = live[left > 8]
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return out


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, with freed memory returned to the system at the end: a worker lives on for other tasks,
    and beside it the JVM may need what it held."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library only
                trim(0)

    return inner


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the int64 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most about ``size`` bytes together."""
    data, offsets = flat(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many each row has. ``inside``: which byte values words are made of."""
    keep = ~SPACE[data] if inside is None else inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = keep[:-1]
    starts = np.flatnonzero(keep & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = keep[1:]
    ends = np.flatnonzero(keep & (~after | edge[1:])) + 1
    bounds = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(bounds)


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-grams of consecutive words, and how many each row has."""
    if n == 1:
        return hashes, counts
    each = np.maximum(counts - n + 1, 0)
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros_like(counts)
    mult = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out += hashes[k : k + total] * mult[k]
    keep = np.ones(total + n, bool)
    last = np.cumsum(counts)
    for k in range(1, n):  # starts from which the row's end is nearer than n words
        at = last - k
        keep[at[(counts >= k) & (at >= 0)]] = False
    return mix(out[keep[:total]]), each


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each row's values, rows lying one after another; it depends on the row alone, not on its neighbours."""
    out = np.zeros(len(counts))
    some = np.flatnonzero(counts)
    if len(some):
        starts = np.cumsum(counts) - counts
        out[some] = np.add.reduceat(values.astype(np.float64), starts[some])
    return out


def window_hashes(names: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive names, wherever they lie; a polynomial from one prefix sum, so n may be large."""
    up, down = _power_tables(len(names) + 1)
    prefix = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(names * up[: len(names)], out=prefix[1:])
    total = max(0, len(names) - n + 1)
    return mix((prefix[n : n + total] - prefix[:total]) * down[:total])
