"""Words and word-sequence hashes of whole texts, computed over Arrow buffers with numpy.

A block of consecutive rows is handled at once. Word and window hashes come from prefix sums: with
``C[i] = sum(v[j] * B**j for j < i)`` mod 2**64, the span [s, e) hashes to ``(C[e] - C[s]) * B**-s``,
whatever its length, and is then mixed. ``B`` is odd, so its inverse exists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: ASCII white space: 0x20 and 0x09-0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte but digits and letters (after lower-casing, A-Z do not occur).
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

BASE_1 = 0x9E3779B97F4A7C15 | 1
BASE_2 = 0xC2B2AE3D27D4EB4F | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: Powers that a worker keeps; a longer text has its own made and dropped.
KEPT = (1 << 18) + (1 << 16)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64, for i from 0 to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, KEPT)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            made.append(p)
        have = (made[0], made[1])
        if size == KEPT:
            _powers[base] = have
    return have


class Prefix:
    """Hashes of any span of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = BASE_1):
        p, self.inverse = powers(len(values), base)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * p[: len(values)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


@dataclass
class Words:
    data: np.ndarray  # bytes of the block, lower-cased if asked
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # words of row i are doc[i]:doc[i + 1]

    def hashes(self) -> np.ndarray:
        return Prefix(self.data.astype(np.uint64) + np.uint64(1)).spans(self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    held = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def blocks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to, bytes, offsets) of about ``limit`` bytes; a longer text is a run by itself."""
    data, offsets = utf8(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of them in each row."""
    where = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=where[1:])
    return pa.ListArray.from_arrays(pa.array(where), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
