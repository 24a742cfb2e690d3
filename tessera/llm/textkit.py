"""NumPy kernels over the bytes of many texts at once.

Texts arrive as Arrow string columns.  Kernels work on parts of about half a megabyte, cut
between texts, so that temporaries stay small whatever the batch size is.  Null texts
count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 1 << 19
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(members: bytes | range | list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Everything but blank, tab, newline, vertical tab, form feed and carriage return.
NOT_BLANK = ~byte_class([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Digits, lower-case letters and all bytes of non-ASCII characters.
ALNUM_LOWER = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n."""
    if len(_powers[0]) < n:
        size = max(n, PART_BYTES + 1)
        for k, base in ((0, BASE), (1, BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def parts(column: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds of each text in them), some rows at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of member bytes, and each text's range among them."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = member[buf]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_CODE[buf] * inverse[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal for equal bytes wherever they stand."""
    power, _ = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * power[starts] + (ends - starts).astype(U64))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(buf), starts, ends)


def shingles(hashes: np.ndarray, ranges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, text by text, and each text's range among them.

    A text with fewer words has one shingle, of all its words; one without words has none.
    """
    counts = np.diff(ranges)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_ranges = np.zeros(len(ranges), np.int64)
    np.cumsum(sizes, out=out_ranges[1:])
    out = np.empty(int(out_ranges[-1]), U64)
    n = len(hashes)
    if n >= k:
        g = np.zeros(n - k + 1, U64)
        for j in range(k):
            g = (g + hashes[j : n - k + 1 + j]) * U64(BASE)
        g = mix(g + U64(k))
    else:
        g = np.zeros(0, U64)
    full = np.flatnonzero(counts >= k)
    if len(full):
        take = np.arange(int(sizes[full].sum())) + np.repeat(ranges[full] - np.r_[0, np.cumsum(sizes[full])[:-1]], sizes[full])
        put = np.arange(len(take)) + np.repeat(out_ranges[full] - np.r_[0, np.cumsum(sizes[full])[:-1]], sizes[full])
        out[put] = g[take]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        h = U64(0)
        with np.errstate(over="ignore"):
            for x in hashes[ranges[d] : ranges[d + 1]]:
                h = (h + x) * U64(BASE)
            out[out_ranges[d]] = mix(np.array([h + U64(counts[d])], U64))[0]
    return out, out_ranges
