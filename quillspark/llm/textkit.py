"""Vectorised text primitives shared by the training-data operators.

Everything works on the raw UTF-8 buffer of an Arrow string column, so no Python
object is made per word: words are byte ranges, and a word's identity is a 64-bit
hash of its bytes.  Batches are cut into slices of about ``SLICE_BYTES`` so that the
temporary arrays stay bounded whatever the Arrow batch size; a document is never
split (one longer than the slice gets a slice of its own).
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

#: Whitespace of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=_U)
    if n > 1:
        out[1] = base
        have = 2
        while have < n:
            take = min(have, n - have)
            out[have : have + take] = out[:take] * _U(pow(base, have, 1 << 64))
            have += take
    return out


class _PowerTable:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.fwd = _powers(_BASE, 1024)
        self.inv = _powers(_INV, 1024)

    def need(self, n: int) -> None:
        if len(self.fwd) < n:
            size = 1 << (n - 1).bit_length()
            self.fwd, self.inv = _powers(_BASE, size), _powers(_INV, size)


_TABLE = _PowerTable()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Slice:
    """Some documents' bytes: document i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Word k is bytes starts[k]:ends[k]; document i has words of[i]:of[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)), offsets


def _trimmer():
    """glibc keeps freed arrays of up to 32 MB; long-lived workers give them back after each batch."""
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


_TRIM = None


def release() -> None:
    """Returns freed memory to the system, where the C library can."""
    global _TRIM
    if _TRIM is None:
        _TRIM = _trimmer() or (lambda _: 0)
    _TRIM(0)
    pa.default_memory_pool().release_unused()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    data, offsets = string_buffer(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield Slice(i, data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64))
        i = j
    release()


def bounds(solid: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> Words:
    """Maximal runs of solid bytes within documents; cut marks bytes at which a new run starts anyway."""
    n = len(solid)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(len(offsets), np.int64))
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    if cut is not None:
        begin |= cut & solid
    full = offsets[:-1][np.diff(offsets) > 0]
    begin[full] = solid[full]
    starts = np.flatnonzero(begin)
    # A run ends where the next one begins or at the first byte that isn't solid.
    close = np.zeros(n + 1, dtype=bool)
    close[1:] = solid
    close[1:n] &= ~solid[1:]
    close[1:n] |= solid[:-1] & begin[1:]
    ends = np.flatnonzero(close)
    return Words(starts, ends, np.searchsorted(starts, offsets))


def words(s: Slice, lower: np.ndarray | None = None) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of each document."""
    return bounds(~SPACE[s.data], s.offsets)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte x power, for the hashes of any byte ranges."""
    _TABLE.need(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * _TABLE.fwd[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes give equal hashes in any slice."""
    return mix((sums[ends] - sums[starts]) * _TABLE.inv[starts] + (ends - starts).astype(_U))


def hash_bytes(b: bytes) -> int:
    d = np.frombuffer(b, dtype=np.uint8)
    return int(range_hash(prefix(d), np.array([0]), np.array([len(d)]))[0])


def segment_sum(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sum of values[of[i]:of[i + 1]] for each i, empty ones 0."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    return total[of[1:]] - total[of[:-1]]
