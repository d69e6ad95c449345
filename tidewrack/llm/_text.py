"""Vectorised text primitives shared by the corpus operators.

Everything works on the raw UTF-8 buffer of an Arrow string column: a batch of
documents is one ``uint8`` array plus row offsets, so hashing every word of a
batch costs a handful of numpy passes and no per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one numpy pass works on; bounds a worker's memory.
SLICE_BYTES = 1 << 20

_R = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_RI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 12, 13, 32]] = True
PLAIN = np.arange(1, 257, dtype=np.uint64)
LOWER = PLAIN.copy()
LOWER[65:91] += np.uint64(32)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    global _power, _inverse
    if len(_power) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("_power", _R), ("_inverse", _RI)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            globals()[name] = np.multiply.accumulate(t)
    return _power, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the result."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each whitespace-delimited word, and each row's first word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~solid[1:]
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of each byte span; equal spans hash equally wherever they stand."""
    power, inverse = _tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(table[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of a row, and each row's first shingle.

    A row of fewer words, but at least one, has one shingle of all its words.
    """
    count = np.diff(first)
    many = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(many, out=at[1:])
    index = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], many)
    last = np.repeat(first[1:], many)
    out = np.zeros(len(index), np.uint64)
    for k in range(width):
        here = index + k
        good = here < last
        if good.all():
            out = mix(out + words[here] + np.uint64(k + 1))
        else:
            out[good] = mix(out[good] + words[here[good]] + np.uint64(k + 1))
    return out, at
