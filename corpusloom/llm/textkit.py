"""Vectorised text primitives on UTF-8 bytes, shared by the operators that leave the JVM.

Arrow string columns are read as one byte buffer with offsets, so no Python string is made for a document. Work goes
slice by slice (about ``SLICE_BYTES`` of text), which bounds memory whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
#: A random value for each byte and an odd multiplier: a polynomial hash modulo 2**64.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))

#: The white space that separates words: blank and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(int(base))
    if have is None or len(have) < n:
        have = _POW[int(base)] = powers(base, max(n, 1 << 16))
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of rows of about ``most`` bytes; a longer row stands alone."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of True in ``member``; runs never cross rows."""
    n = len(member)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    first = member.copy()
    first[1:] &= ~member[:-1] | edge[1:n]
    last = member.copy()
    last[:-1] &= ~member[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, side="right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = SLICE_BYTES) -> np.ndarray:
    """A 64-bit hash of the bytes of each span. Spans are sorted and disjoint; equal bytes give equal hashes."""
    out = np.zeros(len(start), dtype=np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + most, side="right")))
            base = start[lo]
            part = data[base : end[hi - 1]]
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[part] * _powers(_MUL, len(part)), out=total[1:])
            s, e = start[lo:hi] - base, end[lo:hi] - base
            out[lo:hi] = (total[e] - total[s]) * _powers(_INV, len(part) + 1)[s] + (e - s).astype(np.uint64)
            lo = hi
    return mix(out)


def row_sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of True in each row."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
