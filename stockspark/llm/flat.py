"""Vectorised text helpers on Arrow string columns.

A batch of texts is handled as one flat UTF-8 byte array plus offsets (the
Arrow layout), cut into slices of bounded size, so work per task is numpy
passes over bytes and memory does not grow with the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20          # texts are processed in slices of about this size

# word separators of the contracts: space and \x09-\x0D
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on a uint64 array (wraps modulo 2^64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        m = 1 << int(n).bit_length()
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(m + 1, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def text_slices(col: pa.Array, max_bytes: int = SLICE_BYTES
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first_row, end_row, data, offsets)`` over a string column.

    ``data`` is uint8; ``offsets`` has one entry more than there are rows and
    starts at 0. Null rows count as empty. A slice holds whole texts: at least
    one row, and no more than ``max_bytes`` beyond the first row's text.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    if col.null_count:
        col = col.fill_null("")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of non-separator bytes inside each text.

    Returns ``(starts, ends, doc)``: byte bounds and the row each run is in;
    a run never crosses a text boundary.
    """
    if len(data) == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    word = ~separator[data]
    edge = np.empty(len(data) + 1, dtype=bool)     # a run may start / must end here
    edge[0] = edge[-1] = True
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    edge[offsets[(offsets > 0) & (offsets < len(data))]] = True
    cuts = np.flatnonzero(edge)
    first = cuts[:-1]
    keep = word[first]
    starts, ends = first[keep], cuts[1:][keep]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, doc


class RangeHash:
    """64-bit hashes of arbitrary byte ranges of one slice in O(1) each."""

    def __init__(self, data: np.ndarray):
        pw, self._inv = _powers(len(data))
        self._acc = np.empty(len(data) + 1, dtype=np.uint64)
        self._acc[0] = 0
        np.cumsum(_BYTE[data] * pw[:len(data)], out=self._acc[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._acc[ends] - self._acc[starts]) * self._inv[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * U64(0x632BE59BD9B4E019))
