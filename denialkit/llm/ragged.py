"""Ragged numpy views of Arrow string columns: words, hashes and shingles of many texts at once.

A *word* is a maximal run of bytes outside 0x20 and 0x09-0x0D; UTF-8 never uses those bytes inside
a longer character, so byte positions are safe for any text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE, _SEED = 0x9E3779B97F4A7C15 | 1, 20240607
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODE = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = _CODE.copy()
_LOWER[65:91] = _LOWER[97:123]
#: Byte codes under which look-alike digits and signs equal the letters they stand for.
LOOKALIKE = _LOWER.copy()
for _sign, _letter in zip(b"0134578@$!|", b"oieastbasil", strict=True):
    LOOKALIKE[_sign] = LOOKALIKE[_letter]
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling; kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        while len(have) < n:
            have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
        _POWERS[base] = have
    return have[:n]


#: What else a worker forgets at the end of a task: caches of other modules add their ``clear``.
FORGET: list[Callable[[], None]] = [_POWERS.clear]


def tidy() -> None:
    """Gives a reused Python worker's memory back: caches, Arrow's pool, freed pages of the heap."""
    for clear in FORGET:
        clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its pages stay
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 19, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` text bytes and at most ``rows`` rows, which
    bounds a task's memory; one text is never cut. After the last slice the worker is tidied."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = min(start + rows, max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1))
            yield batch.slice(start, stop - start)
            start = stop
    tidy()


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # one past its last byte
    doc: np.ndarray  # row of each word
    at: np.ndarray  # first word of each row, and the number of words at the end

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self, lower: bool = False, codes: np.ndarray | None = None, heads: tuple[int, ...] = ()) -> np.ndarray | list[np.ndarray]:
        """A 64-bit hash of each word's bytes (A-Z lower-cased first if asked, or any other table
        of byte codes); with ``heads`` also of the words' first bytes, so many each."""
        n = len(self.data)
        sums = np.zeros(n + 1, U64)
        np.cumsum((codes if codes is not None else _LOWER if lower else _CODE)[self.data] * powers(_BASE, n), out=sums[1:])
        back = powers(_BASE_INV, n + 1)[self.start]
        ends = [self.end, *(np.minimum(self.end, self.start + k) for k in heads)]
        out = [mix((sums[e] - sums[self.start]) * back + (e - self.start).astype(U64)) for e in ends]
        return out if heads else out[0]


def words(column: pa.Array, outside: np.ndarray = _SPACE) -> Words:
    """The words of a column; ``outside`` marks the byte values that separate words."""
    data, offsets = raw(column)
    return runs(data, offsets, ~outside[data])


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """The maximal runs of bytes marked ``inside``, which never reach over a row's end."""
    n, rows = len(data), len(offsets) - 1
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (before | edge[:n]))
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, start, end, doc, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows))]).astype(np.int64))


def strings(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """An Arrow string column of data[start:start+size]."""
    flat, at = take(data, start, size, np.arange(len(start)))
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])


def take(flat: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates flat[start[r]:start[r]+size[r]] of the rows; also gives where each begins."""
    n = size[rows]
    at = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(at[-1]) + np.repeat(start[rows] - at[:-1], n)], at


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive word hashes that start at each place (len(h)-k+1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if k <= 8:
        out = np.zeros(n, U64)
        for j in range(k):
            out = out * U64(_BASE) + h[j : j + n]
        return mix(out)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(_BASE, len(h)), out=sums[1:])
    return mix((sums[k : k + n] - sums[:n]) * powers(_BASE_INV, n))


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row, words lower-cased; a row with
    fewer words has its whole sequence as one; a row without words has none. Sorted by row, hash."""
    h = w.hashes(lower=True)
    full = grams(h, k)
    inside = np.zeros(len(h), bool)
    inside[: len(full)] = w.doc[: len(full)] == w.doc[k - 1 :] if len(full) else False
    at = np.flatnonzero(inside)
    rows, out = w.doc[at], full[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        tail = np.zeros(len(short), U64)
        for j in range(k - 1):
            here = w.count[short] > j
            tail = np.where(here, tail * U64(_BASE) + h[np.minimum(w.at[short] + j, len(h) - 1)], tail)
        rows = np.concatenate([rows, short])
        out = np.concatenate([out, mix(tail + w.count[short].astype(U64))])
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    if len(rows):
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]) | (out[1:] != out[:-1])
        rows, out = rows[keep], out[keep]
    return rows, out
