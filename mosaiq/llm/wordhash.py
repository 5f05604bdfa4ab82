"""Words of Arrow text columns as arrays of 64-bit hashes, without a Python object for each word.

A word is a maximal run of bytes other than the separators of a 256-entry table.  The hash is multilinear
(a fixed odd random factor for each position, modulo 2**64) with a final mix, so equal words, and in
practice only equal words, share a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Everything but ASCII letters and bytes of non-ASCII characters.
NON_LETTERS = np.ones(256, bool)
NON_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

_POSITIONS = 1024
_R = np.random.default_rng(20240229).integers(0, 2**63, _POSITIONS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FAR = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def lower_utf8(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters (two bytes, the first 0xC3)."""
    out = _LOWER[data]
    if len(out) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most_bytes: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole rows of about ``most_bytes``; a longer row stands alone."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@dataclass
class Words:
    """Words of a run of rows: hash, row (counted from 0), first byte, length in bytes; ``ends[r]`` words up to row r."""

    hashes: np.ndarray
    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    bounds: np.ndarray


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and lengths of the words; no word crosses a row."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> Words:
    start, length = spans(data, offsets, separators)
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    if not len(start):
        return Words(np.zeros(0, np.uint64), row, start, length, bounds)
    return Words(span_hashes(data, start, length), row, start, length, bounds)


def span_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hashes of spans of one byte at least."""
    if not len(start):
        return np.zeros(0, np.uint64)
    cum = np.cumsum(length) - length
    pos = np.arange(int(length.sum())) - np.repeat(cum, length)
    values = (data[pos + np.repeat(start, length)].astype(np.uint64) + np.uint64(1)) * _R[pos & (_POSITIONS - 1)]
    if length.max() > _POSITIONS:
        values *= (pos >> 10).astype(np.uint64) * _FAR * np.uint64(2) + np.uint64(1)
    return mix64(np.add.reduceat(values, cum) + length.astype(np.uint64) * _FAR)


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of ``size`` words that lie in one row; a row with fewer words, but one at
    least, has one window of all its words."""
    n = len(hashes)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if not n:
        return np.zeros(0, np.uint64), row
    full = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        full += hashes[k : k + len(full)] * _R[k]
    ok = np.flatnonzero(np.arange(len(full)) + size <= bounds[row[: len(full)] + 1])
    got, rows = mix64(full[ok] + np.uint64(size)), row[ok]
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        at = bounds[short]
        part = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = counts[short] > k
            part[there] += hashes[at[there] + k] * _R[k]
        got = np.concatenate([got, mix64(part + counts[short].astype(np.uint64))])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        got, rows = got[order], rows[order]
    return got, rows
