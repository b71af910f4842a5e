"""Vectorised word kernels over Arrow string batches.

A word is a run of bytes other than space, tab, LF, VT, FF and CR
(``[^\\x20\\x09-\\x0D]+``; these bytes never occur inside a multi-byte UTF-8
character).  The kernels work on the buffers of an Arrow column in slices of
a few megabytes, so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_CODE[_SPACE] = 0
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(64, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        out = np.empty(max(n, 2 * len(_POWERS)), dtype=np.uint64)
        out[0] = 1
        out[1:] = np.cumprod(np.full(len(out) - 1, _BASE, dtype=np.uint64))
        _POWERS = out
    elif _POWERS[1] == 1:
        _POWERS[1:] = np.cumprod(np.full(len(_POWERS) - 1, _BASE, dtype=np.uint64))
    return _POWERS


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start per row, end per row) of a string column; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
            col = col.cast(pa.string())
        width = np.int32
    n = len(col)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=width)[col.offset:col.offset + n + 1].astype(np.int64) \
        if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1].copy(), offsets[1:].copy()
    if col.null_count:
        null = np.asarray(col.is_null().to_numpy(zero_copy_only=False), dtype=bool)
        ends[null] = starts[null]
    return raw, starts, ends


def slices(starts: np.ndarray, ends: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes (one row at least)."""
    n, i = len(starts), 0
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    while i < n:
        j = int(np.searchsorted(total, total[i] + size, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash per word in text order, number of words per row)."""
    lengths = ends - starts
    n = len(starts)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    if n == 1 or bool(np.all(starts[1:] == ends[:-1])):
        b = raw[starts[0]:ends[-1]]
    else:
        b = np.concatenate([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())])
    row_at = np.concatenate([[0], np.cumsum(lengths)])
    if lower:
        b = _LOWER[b]
    inside = ~_SPACE[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = row_at[:-1][lengths > 0]
    first[edges] = inside[edges]
    at = np.flatnonzero(first)
    if len(at) == 0:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    counts = np.searchsorted(at, row_at[1:]) - np.searchsorted(at, row_at[:-1])
    span = np.diff(np.append(at, len(b)))
    pos = np.arange(at[0], len(b)) - np.repeat(at, span)
    code = _BYTE_CODE[b[at[0]:]]
    code *= _powers(int(span.max()) + 1)[pos]
    h = np.add.reduceat(code, at - at[0])
    return mix64(h), counts


def crc32_text(ids: np.ndarray) -> np.ndarray:
    """crc32 of each id written as decimal text (as Spark's crc32(string))."""
    import zlib
    return np.fromiter((zlib.crc32(str(int(i)).encode()) for i in ids), dtype=np.int64, count=len(ids))
