"""Whole Arrow batches of texts as numpy arrays: words, their places and their 64-bit fingerprints.

Tasks read texts in blocks of a bounded number of bytes (one text may be longer than that and is then a block of
its own). All texts of a block lie in one byte array, each followed by a line feed, so that no word crosses texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ALNUM = np.ones(256, bool)  # the bytes of words made of letters, digits and everything beyond ASCII
ALNUM[:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices with about `most` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)


class Texts:
    """The bytes of a block: `data`, and where each text begins (`starts`) and ends (`ends`, its line feed)."""

    def __init__(self, column: pa.Array, table: np.ndarray | None = None):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        joined = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        _, offsets, data = joined.buffers()
        offsets = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        if table is not None:
            self.data = table[self.data]
        self.starts = offsets[:-1] - offsets[0]
        self.ends = offsets[1:] - offsets[0] - 1
        self.rows = len(joined)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and row of each longest run of bytes for which `inside` holds."""
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return begin, end, self.row_of(begin)

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(is_word[self.data])

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def prints(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit fingerprint of each stretch of bytes; equal stretches have equal fingerprints."""
        up, down = _power(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=sums[1:])
        return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of the multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def forget() -> None:
    """Give up this module's tables; for the end of a task in a worker that goes on."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    trim()


def trim() -> None:
    """Hand memory that was freed back to the system, which Arrow's pool and the C library would keep for the next task."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def shingles(prints: np.ndarray, row: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and row of each run of `n` words; a row with fewer words, but not none, has one run of them all."""
    counts = np.bincount(row, minlength=rows)
    first = np.cumsum(counts) - counts
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    of = np.repeat(np.arange(rows), runs)
    at = np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    out, left = np.zeros(len(at), np.uint64), np.minimum(counts, n)[of]
    padded = np.concatenate([prints, np.zeros(n, np.uint64)])
    for k in range(n):
        out = np.where(k < left, mix(out * np.uint64(3) + padded[at + k]), out)
    return out, of


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive values as one list a row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
