"""Vectorised word scanning over Arrow string buffers, used inside Arrow tasks.

A batch's UTF-8 buffer is scanned whole with numpy: no Python string is made per row. Word rules are
byte rules, which is exact here because every class below treats all bytes of a multi-byte code point alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCAN_BYTES = 1 << 20  # bytes scanned at a time; a longer text is scanned alone
_PRIME = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_class(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: words `[^\x20\x09-\x0D]+`
SPACED = _byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: letters only (ASCII letters and everything beyond ASCII), after lower-casing A-Z
LETTERS = _byte_class(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread values from any uint64 input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
    up, down = np.full(n + 1, _PRIME), np.full(n + 1, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@dataclass
class Words:
    """The words of rows first..last-1 of a batch."""

    first: int
    last: int
    data: np.ndarray  # lower-cased bytes
    starts: np.ndarray  # byte positions in data
    ends: np.ndarray
    per_row: np.ndarray  # words in each row
    prefix: np.ndarray  # running polynomial sums, for hashes of any byte range

    @property
    def row_of(self) -> np.ndarray:
        """Row (from 0, within this scan) of each word."""
        return np.repeat(np.arange(len(self.per_row)), self.per_row)

    @property
    def bounds(self) -> np.ndarray:
        """Word index at which each row starts, with the total at the end."""
        return np.concatenate(([0], np.cumsum(self.per_row)))

    def hash_range(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
        _, down = _powers(_rounded(len(self.data)))
        return mix((self.prefix[ends] - self.prefix[starts]) * down[starts] + np.uint64(1))

    def hashes(self) -> np.ndarray:
        return self.hash_range(self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _rounded(n: int) -> int:
    return max(SCAN_BYTES, 1 << max(0, n - 1).bit_length())


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if raw else np.zeros(1, np.int32)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def joined(column: pa.Array | pa.ChunkedArray) -> memoryview:
    """The bytes of all values of a binary column, one after another, without a copy for each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return memoryview(b"")
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(data)[offsets[0] : offsets[-1]]


def row_slices(offsets: np.ndarray, at_most: int = SCAN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about at_most bytes, a longer row alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + at_most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def scan(column: pa.Array | pa.ChunkedArray, kind: np.ndarray, at_most: int = SCAN_BYTES) -> Iterator[Words]:
    """The words of a string column, in scans of about at_most bytes."""
    data, offsets = text_buffer(column)
    for first, last in row_slices(offsets, at_most):
        lo, hi = offsets[first], offsets[last]
        text = _LOWER[data[lo:hi]]
        edges = offsets[first : last + 1] - lo
        inside = kind[text]
        n = len(text)
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cut = edges[(edges > 0) & (edges < n)]
        before[cut], after[cut - 1] = False, False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        up, _ = _powers(_rounded(n))
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[text] * up[:n], out=prefix[1:])
        yield Words(first, last, text, starts, ends, np.diff(np.searchsorted(starts, edges)), prefix)
