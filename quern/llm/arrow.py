"""Whole texts as numpy byte arrays: what the corpus operators share on the Arrow path.

A batch that Spark hands over is cut into pieces of a few MB, so that working memory is
bounded by the piece (or by one document, which is never cut here).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20

#: The white space of the word rule, [\x20\x09-\x0D].
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


class Texts(NamedTuple):
    """The texts of some rows, one after the other: text i is data[at[i]:at[i + 1]]."""

    data: np.ndarray
    at: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


class Words(NamedTuple):
    """Byte ranges of all words; those of text i are first[i]:first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column's texts in each hold about limit bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = texts(batch.column(column)).at
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def texts(column: pa.Array) -> Texts:
    """The bytes of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def words(t: Texts) -> Words:
    """Maximal runs of non-space bytes; no word crosses the end of a text."""
    solid = ~IS_SPACE[t.data]
    n = len(solid)
    before = np.ones(n, bool)
    before[1:] = ~solid[:-1]
    before[t.at[t.at < n]] = True
    after = np.ones(n, bool)
    after[:-1] = ~solid[1:]
    after[t.at[t.at > 0] - 1] = True
    start = np.flatnonzero(solid & before)
    return Words(start, np.flatnonzero(solid & after) + 1, np.searchsorted(start, t.at))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ODD and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + (64 << 10))
        _powers[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64)))) for x in (ODD, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * ODD^-i before each position: range_hash takes hashes of ranges from them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[1], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes that depend on the values in each range alone."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[0][start] + (end - start).astype(np.uint64) * ODD)


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_TABLE[data])


def word_hashes(t: Texts, w: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, of the A-Z lower-cased one on request."""
    return range_hash(byte_sums(LOWER[t.data] if lower else t.data), w.start, w.end)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words, and where each text's begin.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    count = np.diff(first)
    number = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(number)))
    begin = np.repeat(first[:-1], number) + np.arange(at[-1]) - np.repeat(at[:-1], number)
    return range_hash(prefix_sums(hashes), begin, begin + np.repeat(np.minimum(count, n), number)), at
