"""Word shingles of Arrow text columns, hashed in numpy without making Python strings.

A word is a maximal run of bytes outside ASCII white space; only A-Z are lower-cased.
A shingle is a 64-bit fingerprint of ``width`` consecutive words; a text of fewer words
has one fingerprint of its whole sequence, and a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at once; one longer text is a chunk of its own.
CHUNK_BYTES = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """An invertible 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and first byte of each word of ``data``."""
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first
    length = last - first
    power = np.ones(int(length.max()), np.uint64)
    np.multiply.accumulate(np.full(len(power) - 1, _BASE), out=power[1:]) if len(power) > 1 else None
    start = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(start, length)
    values = _BYTE[_LOWER[data[inside]]] * power[place]
    return mix(np.add.reduceat(values, start) + length.astype(np.uint64)), first


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct fingerprints of each row, in row order."""
    data, offsets = text_buffers(column)
    for i, j in chunks(offsets):
        piece = data[offsets[i] : offsets[j]]
        # rows do not run together: a space stands between any two
        lengths = np.diff(offsets[i : j + 1])
        rows = np.full(len(piece) + (j - i), 0x20, np.uint8)
        rows[np.arange(len(piece)) + np.repeat(np.arange(j - i), lengths)] = piece
        words, first = word_hashes(rows)
        bounds = np.searchsorted(first, offsets[i : j + 1] - offsets[i] + np.arange(j - i + 1))
        joined = np.zeros(0, np.uint64)
        if len(words) >= width:
            joined = words[: len(words) - width + 1].copy()
            for k in range(1, width):
                joined = mix(joined) * _BASE + words[k : len(words) - width + 1 + k]
            joined = mix(joined)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n = b - a
            if n >= width:
                yield np.unique(joined[a : b - width + 1])
            elif n:
                whole = np.array([n], np.uint64)
                for w in words[a:b]:
                    whole = mix(whole * _BASE + w)
                yield whole
            else:
                yield np.zeros(0, np.uint64)
