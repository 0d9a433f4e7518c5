"""Vectorised text kernels over Arrow string columns.

A batch of texts is one UTF-8 byte buffer plus offsets. Words are the maximal runs
``[^\\x20\\x09-\\x0D]+``; as all six separators are ASCII, splitting bytes equals splitting code points. Every word
gets a 64-bit hash, a sum over its bytes of R[byte] * B**position modulo 2**64, mixed at the end; no Python object is
made per word. Chunks hold whole texts, so memory is bounded by the larger of CHUNK_BYTES and the longest text; a long
text is weighed in parts, which leaves 24 bytes a word of it.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What a worker has freed goes back to the machine, rather than stay with the worker: arrays of 1 MB or more are mapped one by one.
pa.set_memory_pool(pa.system_memory_pool())
with contextlib.suppress(OSError, AttributeError):  # another C library has its own ways
    ctypes.CDLL(None).mallopt(-3, 1 << 20)

CHUNK_BYTES = 1 << 21
HASH_BYTES = 1 << 16

_U = np.uint64
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_HASH = np.random.default_rng(20240229).integers(1, 2**64, size=256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)
_GRAM_BASE = _U(0xD1342543DE82EF95)
_powers = np.ones(1, dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that spreads every input bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 64), _BASE, dtype=np.uint64)
        out[0] = 1
        _powers = np.cumprod(out, dtype=np.uint64)
    return _powers


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - (offsets[0] if len(offsets) else 0)


@dataclass
class Words:
    """Words of the texts first..first+n of a batch; word w of text d has index bounds[d] <= w < bounds[d + 1]."""

    first: int
    data: np.ndarray  # bytes of the chunk
    offsets: np.ndarray  # of the texts, n + 1
    starts: np.ndarray  # of the words, in data
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """The words' hashes, HASH_BYTES at a time, which stay in a processor's cache; a longer word is a part of its own."""
    out = np.zeros(len(starts), dtype=np.uint64)
    table = _BYTE_HASH[_LOWER] if lower else _BYTE_HASH
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + HASH_BYTES, side="right")))
        high = ends[last - 1]
        at = starts[first:last] - low
        weights = table[data[low:high]]
        weights[_IS_SPACE[data[low:high]]] = 0
        position = np.arange(high - low) - np.repeat(at, np.diff(np.append(at, high - low)))
        position[position >= (longest := int((ends[first:last] - starts[first:last]).max()))] = 0
        weights *= powers(longest)[position]
        out[first:last] = np.add.reduceat(weights, at)
        first = last
    return mix64(out)


def segment(data: np.ndarray, offsets: np.ndarray, first: int = 0, lower: bool = False) -> Words:
    n = len(data)
    spaces = _IS_SPACE[data]
    head = np.ones(n + 1, dtype=bool)
    head[1:n] = spaces[: n - 1]
    head[offsets] = True
    starts = np.flatnonzero(head[:n] & ~spaces)
    tail = np.ones(n, dtype=bool)
    tail[: n - 1] = spaces[1:]
    inner = offsets[1:] - 1
    tail[inner[inner >= 0]] = True
    ends = np.flatnonzero(tail & ~spaces) + 1
    return Words(first, data, offsets, starts, ends, np.searchsorted(starts, offsets), hash_words(data, starts, ends, lower))


def chunks(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[Words]:
    data, offsets = strings(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield segment(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, lower)
        first = last


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each index on; the last k - 1 indexes have none. Windows may cross texts: see starts_of."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _GRAM_BASE
        out += hashes[j : j + n]
    return mix64(out)


def gram_counts(bounds: np.ndarray, k: int) -> np.ndarray:
    return np.maximum(np.diff(bounds) - (k - 1), 0)


def gram_starts(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes at which k words of one text start, and the n + 1 bounds of the texts among them."""
    counts = gram_counts(bounds, k)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], counts), ends


def reduce_by_text(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty: float = 0) -> np.ndarray:
    """ufunc over each text's values; bounds may hold empty ranges, which get `empty`."""
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
