"""Vectorised words and shingles over the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
#: Bytes of text that one numpy pass works on, whatever the size of an Arrow batch.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * GOLDEN)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every byte but ASCII letters and digits and those of other characters.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = randoms(256, 1)[LOWER] | np.uint64(1)
PLACE = randoms(1 << 12, 2) | np.uint64(1)


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of about size bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows given by offsets, and the word offset of each row.

    A word is a run of bytes outside gaps (0x20 and 0x09-0x0D), with A-Z lower-cased.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    # a byte of gaps ends each row
    buf = np.full(int(lengths.sum()) + n, np.flatnonzero(gaps)[0], np.uint8)
    keep = np.ones(len(buf), bool)
    ends = np.cumsum(lengths + 1)
    keep[ends - 1] = False
    buf[keep] = data[offsets[0] : offsets[-1]]
    gap = gaps[buf]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    rows = np.searchsorted(starts, np.concatenate([[0], ends]))
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    place = np.arange(starts[0], len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf))))
    longest = int(place[~gap[starts[0] :]].max()) + 1
    table = PLACE if longest <= len(PLACE) else randoms(longest, 2) | np.uint64(1)
    value = np.where(gaps, np.uint64(0), BYTE)[buf[starts[0] :]] * table[np.minimum(place, len(table) - 1)]
    return mix(np.add.reduceat(value, starts - starts[0])), rows


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text; of the whole text if it has fewer, none if it has none."""
    n = len(hashes)
    if not n:
        return hashes
    m = min(k, n)
    factor = randoms(k, 3) | np.uint64(1)
    out = np.full(n - m + 1, m, np.uint64) * GOLDEN
    for j in range(m):
        out += hashes[j : n - m + 1 + j] * factor[j]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row."""
    for a, b in chunks(offsets):
        hashes, rows = words(data, offsets[a : b + 1])
        for i in range(b - a):
            yield np.unique(shingles(hashes[rows[i] : rows[i + 1]], k))
