"""Hashes of the words of whole Arrow text columns, and of runs of words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Batches are worked on in slices of about so many bytes of text; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000
#: Hashes of words come from so many bytes at a time.
STEP_BYTES = 1 << 16
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of the 64-bit split-mix generator, over an array."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and below 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


_BYTES = mix(np.arange(256, dtype=np.uint64), 1) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], dtype=np.uint64, out=sums[1:])
    return (sums[end] - sums[begin]) * down[begin]


def spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[begin:end] for each pair, from prefix sums."""
    return mix(_sums(values, begin, end))


def byte_spans(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, step: int = STEP_BYTES) -> np.ndarray:
    """spans() of the numbers of bytes, for ranges in ascending order that don't overlap; ``step`` bytes at a time, so that no array of numbers is as long as the text."""
    out, i = np.empty(len(begin), np.uint64), 0
    while i < len(begin):
        at, j = int(begin[i]), int(np.searchsorted(end, begin[i] + step, "right"))
        if j > i:
            out[i:j] = _sums(_BYTES[raw[at : end[j - 1]]], begin[i:j] - at, end[i:j] - at)
            i = j
        else:  # one range that is longer
            total = 0
            for k in range(at, int(end[i]), step):
                values = _BYTES[raw[k : min(k + step, end[i])]]
                total += int((values * powers(len(values))[0]).sum(dtype=np.uint64)) * pow(int(_BASE), k - at, 1 << 64)
            out[i], i = np.uint64(total & 0xFFFFFFFFFFFFFFFF), i + 1
    return mix(out)


def text_bytes(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row starts in them (one more entry than rows); null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, name: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


class Words:
    """The words (runs without ASCII white space) of a text column.

    begin, end: byte positions in ``raw``; first[i]:first[i + 1] are the words of row i; hash: of each word.
    """

    def __init__(self, column: pa.StringArray) -> None:
        self.raw, self.at = text_bytes(column)
        blank = (self.raw == 0x20) | ((self.raw >= 9) & (self.raw <= 13))
        edge = np.zeros(len(self.raw) + 1, bool)
        edge[self.at] = True
        edge[1:-1] |= blank[:-1] | blank[1:]
        self.begin = np.flatnonzero(~blank & edge[:-1])
        self.end = np.flatnonzero(~blank & edge[1:]) + 1
        self.first = np.searchsorted(self.begin, self.at)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = byte_spans(self.raw, self.begin, self.end)

    def grams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(positions of first words, hashes) of all runs of ``n`` words within a row."""
        at = np.flatnonzero(np.arange(len(self.begin)) + n <= self.first[1:][self.row]) if len(self.begin) else np.zeros(0, np.int64)
        return at, mix(spans(mix(self.hash, seed), at, at + n), seed)
