"""Vectorised text kernels that run inside Spark tasks on Arrow batches.

Texts are handled as the UTF-8 bytes of an Arrow string column.  A polynomial prefix hash gives every word, and every
run of consecutive words, a 64-bit hash without a Python loop over words.  Work is done in chunks of about half a megabyte
of whole documents, so memory follows the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 19
LONG_WORD = 64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of words made of ASCII letters and digits and of everything outside ASCII.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = True
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    NOT_ALNUM[_lo : _hi + 1] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in [0, n)."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.ones(size, dtype=np.uint64)
            t[1:] = np.uint64(b)
            np.multiply.accumulate(t, out=t)
            out.append(t)
        have = _tables[base] = (out[0], out[1])
    return have


@dataclass
class Words:
    """Words of some documents: byte positions, and for document i the words at bounds[i]:bounds[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A well mixed 64-bit hash of each word's bytes."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        power, inverse = _powers(_BYTE_BASE, n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
        size = (self.end - self.start).astype(np.uint64)
        out = mix64((prefix[self.end] - prefix[self.start]) * inverse[self.start] + size * np.uint64(0x2545F4914F6CDD1D))
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return out


def window_hashes(word_hash: np.ndarray, bounds: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one document, and the index of each run's first word."""
    n = len(word_hash)
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    first = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)
    power, inverse = _powers(_WORD_BASES[which], n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(word_hash * power[:n], out=prefix[1:])
    return mix64((prefix[first + width] - prefix[first]) * inverse[first] + np.uint64(width)), first


def whole_hash(word_hash: np.ndarray) -> np.uint64:
    """The hash that a run of all these words has."""
    return window_hashes(word_hash, np.array([0, len(word_hash)]), len(word_hash))[0][0]


def split_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are no separators, cut at the document boundaries in ``offsets``."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(separator[data], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] |= inside[1:-1][edge]
    ends[edge - 1] |= inside[1:-1][edge - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents with about ``limit`` bytes."""
    data, offsets = text_buffer(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def shingle_sets(word_hash: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's ``width``-word shingles; a shorter document is one shingle."""
    hashes, first = window_hashes(word_hash, bounds, width)
    cut = np.searchsorted(first, bounds)
    out = []
    for i in range(len(bounds) - 1):
        a, b = cut[i], cut[i + 1]
        if b > a:
            out.append(np.unique(hashes[a:b]))
        elif bounds[i + 1] > bounds[i]:
            out.append(np.array([whole_hash(word_hash[bounds[i] : bounds[i + 1]])], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
