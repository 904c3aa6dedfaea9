"""Vectorised text primitives over Arrow columns (numpy): blocks of bytes, words, hashes, shingles.

A polynomial hash over a prefix sum gives the hash of any byte range of a block in O(1), so words and n-grams of a
whole block are hashed without a Python loop. A null text counts as an empty one everywhere here.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at a time; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

#: Byte tables. ASCII lower case; word bytes of the alphanumeric kind (all of UTF-8 beyond ASCII included); non-blank bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
NONBLANK = np.ones(256, bool)
NONBLANK[[0x20, *range(0x09, 0x0E)]] = False


#: What operators keep in a worker process from task to task; work on blocks drops it, as the process is then another's.
CACHES: list[dict] = []


def drop_caches() -> None:
    if any(CACHES):
        for c in CACHES:
            c.clear()
        gc.collect()


def trimmed() -> None:
    """Freed memory goes back to the system."""
    gc.collect()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run):
    """run over batches, for a worker process that others use later: freed memory goes back to the system at the end."""

    def tidied(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        trimmed()

    return tidied


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        grown = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            p[0] = 1
            grown.append(np.cumprod(p))
        _powers = (grown[0], grown[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash are usable."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a text column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0] or column.buffers()[2] is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows of at most limit bytes, or of one longer row."""
    drop_caches()
    offsets, data = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash takes the hash of any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row boundary the number of words before it."""
    m = is_word[data]
    starts, ends = m.copy(), m.copy()
    starts[1:] &= ~m[:-1]
    ends[:-1] &= ~m[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    starts[first], ends[last] = m[first], m[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_bounds and the hash of each word in ASCII lower case: (start, end, row boundaries, hash)."""
    s, e, rows = word_bounds(data, offsets, is_word)
    return s, e, rows, range_hash(prefix(LOWER[data]), s, e)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes; runs across rows are for the caller to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _STEP[0]
    for j in range(1, k):
        out = out + h[j : n + j] * _STEP[j]
    return mix(out + np.uint64(k))


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a short whole sequence of word hashes, the same as that of a shingle of its length."""
    return shingles(h, len(h))[0]


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array for each row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def empty(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
