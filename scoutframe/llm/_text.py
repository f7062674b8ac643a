"""Whole-batch text work on Arrow buffers: words, distinct words, rolling hashes and anchors.

Everything here runs inside tasks, on slices of a bounded number of bytes (a
longer text is a slice of its own), with no loop over characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES):
    """Consecutive parts of a batch with about ``size`` bytes of ``column`` each."""
    if not batch.num_rows:
        return
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = lengths[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(lengths, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Says how to let go of what an operator keeps in a Python worker between tasks."""
    _kept[owner] = clear


def only(owner: str) -> None:
    """Workers are used again by other operators: what all others keep goes, and its memory returns to the machine."""
    for name, clear in _kept.items():
        if name != owner:
            clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and where each begins (one more offset than texts); null is empty."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the runs ``[start, start + length)``, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def per_text(cut_at: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many of the sorted ``marks`` lie in each text."""
    return np.diff(np.searchsorted(marks, cut_at))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class SpanHasher:
    """64-bit polynomial hashes of any spans of a sequence of values, mixed; equal spans have equal hashes."""

    def __init__(self, values: np.ndarray):
        up, self._down = _power_tables(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self._sums[1:], dtype=np.uint64)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def without(self, starts: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of spans with the value at ``places`` cut out: prefix and suffix hashes, joined; as ``spans`` of what is left."""
        left = self._sums[places] - self._sums[starts] + (self._sums[ends] - self._sums[places + 1]) * _INVERSE
        return mixed(left * self._down[starts])

    def windows(self, size: int) -> np.ndarray:
        """Of every window of ``size`` values, by its start."""
        n = max(0, len(self._sums) - size)
        return mixed((self._sums[size : size + n] - self._sums[:n]) * self._down[:n])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of a slice of texts: where each starts and ends in the bytes, and the first word of each text."""

    def __init__(self, texts: pa.Array, table: np.ndarray | None = None, white: np.ndarray = _WHITE):
        self.data, cut = bytes_of(texts)
        if table is not None:
            self.data = table[self.data]
        gap = np.ones(len(self.data) + 2, bool)
        gap[1:-1] = white[self.data]
        # a text's end parts words, too
        edge = np.zeros(len(self.data) + 1, bool)
        edge[cut] = True
        inside = ~gap[1:-1]
        begins = inside & (gap[:-2] | edge[:-1])
        stops = inside & (gap[2:] | edge[1:])
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.cut = np.searchsorted(self.starts, cut)
        self.byte_cut = cut

    def hashes(self) -> np.ndarray:
        return SpanHasher(self.data).spans(self.starts, self.ends)


def lower_words(texts: pa.Array) -> Words:
    """Words between ASCII white space, A-Z in lower case."""
    return Words(texts, _LOWER)
