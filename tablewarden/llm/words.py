"""Words and word n-grams of Arrow text columns as 64-bit numbers, by numpy over whole slices.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, so a slice of texts is cut without
decoding it. Every byte of a text counts; slices only bound how much is held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(seed: int, count: int) -> np.ndarray:
    """``count`` fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        step = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(step + np.uint64(seed)) | np.uint64(1)


_BYTE = numbers(11, 256)
_GRAM = numbers(23, 64)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text, or one longer row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets into them; null counts as empty."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column])  # drops the offset of a slice
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(ends[0]), int(ends[-1])
    data = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return data, ends - first


class Words:
    """Words of a slice: ``starts`` and ``ends`` in ``data``; row i has words first[i]:first[i+1]."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.offsets = text_bytes(column)
        self.data = _LOWER[data] if lower else data
        space = _SPACE[self.data]
        inside = ~space
        filled = self.offsets[:-1][self.offsets[1:] > self.offsets[:-1]]
        begins = np.empty(len(data), bool)
        finishes = np.empty(len(data), bool)
        if len(data):
            begins[0] = True
            begins[1:] = space[:-1]
            begins[filled] = True
            finishes[-1] = True
            finishes[:-1] = space[1:]
            finishes[filled[1:] - 1] = True
        self.starts = np.flatnonzero(inside & begins)
        self.ends = np.flatnonzero(inside & finishes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self._inside = inside

    @staticmethod
    def bytes_of(column: pa.Array) -> np.ndarray:
        """The same bytes before any lower-casing."""
        return text_bytes(column)[0]

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One number per word, from all its bytes and their places."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            sizes = self.ends - self.starts
            begin = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
            weights = numbers(37, int(sizes.max()))
            values = _BYTE[self.data[self._inside]]
            values *= weights[place]
            return mix(np.add.reduceat(values, begin) + sizes.astype(np.uint64))

    def grams(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all runs of ``n`` words inside a row, and how many each row has."""
        h = self.hashes() if hashes is None else hashes
        count = self.counts()
        each = np.maximum(count - n + 1, 0)
        if len(h) < n:
            return np.zeros(0, np.uint64), each
        with np.errstate(over="ignore"):
            size = len(h) - n + 1
            total = np.zeros(size, np.uint64)
            for i in range(n):
                total += h[i : i + size] * _GRAM[i % 64]
                if i % 64 == 63:
                    total = mix(total)
        return mix(total[starts_of(self.first[:-1], each)]), each


def starts_of(first: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i]+1, ... of each[i] places, row after row."""
    total = int(each.sum())
    begin = np.cumsum(each) - each
    return np.repeat(first - begin, each) + np.arange(total)
