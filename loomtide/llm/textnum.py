"""Vectorised word and shingle hashing over Arrow string batches (numpy only).

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
A word's hash is a polynomial over random 64-bit byte values, taken from prefix
sums, so that no Python object is made per word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_VALUE[65:91] = _VALUE[97:123]
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


@functools.cache
def _power() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for the bytes of a chunk."""
    out = []
    for base in (_BASE, _INV):
        p = np.full(CHUNK_BYTES + 1, base, dtype=U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) slices of a string column of at most ``limit`` bytes, or of one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), at + 60_000, len(column))
        yield at, end - at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per row)."""
    n = len(data)
    rows = len(offsets) - 1
    if n == 0:
        return np.zeros(0, U), np.zeros(rows, np.int64)
    inside = _WORD[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(inside & ~after) + 1
    h = np.empty(len(start), dtype=U)
    at = 0
    while at < len(start):  # so many words at a time as fit into a chunk, or one longer word
        end = max(int(np.searchsorted(stop, start[at] + CHUNK_BYTES, side="right")), at + 1)
        a, z = int(start[at]), int(stop[end - 1])
        if z - a > CHUNK_BYTES:
            h[at] = _long_word(data[a:z])
        else:
            up, down = _power()
            total = np.empty(z - a + 1, dtype=U)
            total[0] = 0
            np.cumsum(_VALUE[data[a:z]] * up[: z - a], out=total[1:])
            h[at:end] = mix((total[stop[at:end] - a] - total[start[at:end] - a]) * down[start[at:end] - a])
        at = end
    counts = np.diff(np.searchsorted(start, offsets))
    return h, counts


def _long_word(data: np.ndarray) -> np.uint64:
    """The hash of one word of more than a chunk, summed chunk by chunk."""
    up, _ = _power()
    total, shift, step = 0, 1, pow(_BASE, CHUNK_BYTES, 1 << 64)
    for at in range(0, len(data), CHUNK_BYTES):
        part = data[at : at + CHUNK_BYTES]
        total = (total + int((_VALUE[part] * up[: len(part)]).sum(dtype=U)) * shift) % (1 << 64)
        shift = shift * step % (1 << 64)
    return mix(np.array([total], dtype=U))[0]


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, rising within the row, and how many there are.

    A row with fewer than ``width`` words, but at least one, has its whole
    sequence as its only shingle; a row without words has none.
    """
    rows = len(counts)
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    total = len(hashes)
    full = np.maximum(counts - width + 1, 0)
    n_full = int(full.sum())
    row_of = np.repeat(np.arange(rows), full)
    at = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first[:-1], full)
    h = np.full(n_full, U(width), dtype=U)
    for j in range(width):
        h = mix(h * U(0x9E3779B97F4A7C15) + hashes[at + j]) if n_full else h
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = counts[short].astype(U)
        for j in range(int(counts[short].max())):
            live = counts[short] > j
            pos = np.minimum(first[short] + j, total - 1)
            extra = np.where(live, mix(extra * U(0x9E3779B97F4A7C15) + hashes[pos]), extra)
        h = np.concatenate([h, extra])
        row_of = np.concatenate([row_of, short])
    order = np.argsort(h)
    order = order[np.argsort(row_of[order].astype(np.uint16), kind="stable")]
    h, row_of = h[order], row_of[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row_of[1:] != row_of[:-1])
        h, row_of = h[new], row_of[new]
    return h, np.bincount(row_of, minlength=rows).astype(np.int64)


def sums(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """Exact sums modulo 2**64 of ``values`` by ``index`` (two 32-bit halves; exact below 2**21 values a sum)."""
    lo = np.bincount(index, weights=(values & U(0xFFFFFFFF)).astype(np.float64), minlength=size)
    hi = np.bincount(index, weights=(values >> U(32)).astype(np.float64), minlength=size)
    return lo.astype(U) + (np.fmod(hi, 2.0**32).astype(U) << U(32))
