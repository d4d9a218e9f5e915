"""Words of Arrow text columns as byte runs, found and hashed without a loop over words.

Both word classes of this package are sets of bytes in UTF-8: every byte of a non-ASCII
character is a word byte, every separator is one ASCII byte.  So a batch of texts is one
byte array, and words, hashes and windows are array operations on it.

Tasks never turn a whole Arrow batch into arrays at once: ``slices`` cuts it into runs of
rows of at most ``SLICE_BYTES`` text bytes (one longer text is a run of its own), so memory
follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]`: all bytes but blank, tab, newline, vertical tab, form feed, return
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing: digits, a-z, all non-ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class _Powers:
    """Powers of an odd base modulo 2^64, grown on demand and kept per worker."""

    def __init__(self, base: int):
        self.base = base
        self.table = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            grown = np.full(max(n, 2 * len(self.table)), self.base, dtype=np.uint64)
            grown[0] = 1
            self.table = np.cumprod(grown, dtype=np.uint64)
        return self.table[:n]


_powers: dict[int, _Powers] = {}


def powers(base: int, n: int) -> np.ndarray:
    return _powers.setdefault(base, _Powers(base)).upto(n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text, at least one row each."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = text_bytes(column)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


@dataclass
class Words:
    """Words of a run of texts: byte bounds, the row of each, and each row's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word; equal bytes give equal hashes in every task."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + _U(1)) * powers(_BASE, n), out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * powers(_inverse(_BASE), n)[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))


def find_words(column: pa.Array, is_word: np.ndarray, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = is_word[data]
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(len(offsets), np.int64))
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def run_hashes(words: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of every ``size`` consecutive values; position j covers j .. j + size - 1."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - size + 1].copy()
    for j in range(1, size):
        out *= _U(base)
        out += words[j : len(words) - size + 1 + j]
    return mix(out)


class Prefix:
    """Hashes of arbitrary runs of values: one prefix sum, two lookups a run."""

    def __init__(self, values: np.ndarray, base: int):
        self.base = base | 1
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(self.base, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(_inverse(self.base), len(self.sums))
        h = (self.sums[end] - self.sums[start]) * back[start]
        return mix(h + (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def spaced(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one blank, with each word's bounds in those bytes.

    Rows follow one another, also with one blank between; row r's words i .. j are
    ``joined[start[i]:end[j]]``.
    """
    size = words.end - words.start
    start = np.zeros(len(size), np.int64)
    if not len(size):
        return b"", start, start
    np.cumsum(size[:-1] + 1, out=start[1:])
    end = start + size
    out = np.full(int(end[-1]), 0x20, np.uint8)
    keep = np.zeros(len(words.data) + 1, np.int8)
    keep[words.start] += 1
    keep[words.end] -= 1
    held = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    place = np.zeros(len(out) + 1, np.int8)
    place[start] += 1
    place[end] -= 1
    out[np.cumsum(place[:-1], dtype=np.int8).astype(bool)] = words.data[held]
    return out.tobytes(), start, end


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(values.view(np.int64))


def list_array(values: pa.Array, row: np.ndarray, rows: int) -> pa.Array:
    """One list a row from values ordered by row."""
    bounds = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), values)
