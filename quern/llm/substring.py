"""Substring dedup: words covered by a 20-word window that also starts earlier.

The runs of ``repeats`` meet in shards by a gram that their windows share. Each shard builds a
compressed FM-index over its runs: the Burrows-Wheeler transform in a wavelet matrix whose bit
vectors answer rank from packed words and a count for every 64 bits. The shard's runs are then
streamed against it: backward search extends all windows word by word as long as another
occurrence remains, which gives their matching statistics up to the window length, and windows that
reach it have an interval of the suffix array with all their occurrences. The first
occurrence of each interval stays, all later ones are reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.arrow import texts, words
from quern.llm.repeats import Contexts, Spec, applied, covered, unpacked

LENGTH = 20
GRAM = 8


class Bits:
    """A bit vector with rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words))))[:-1].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)


class Index:
    """An FM-index over integer symbols 0 to alphabet - 1."""

    def __init__(self, text: np.ndarray, array: np.ndarray, alphabet: int) -> None:
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.total = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        row = text[array - 1]
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        self.base = self._down(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros, strict=True):
            ones = bits.ones(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one symbol more to the left."""
        shift = self.total[symbol] - self.base[symbol]
        return shift + self._down(symbol, low), shift + self._down(symbol, high)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in ascending order by doubling; symbols at ends of runs are all different."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, reach = len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = np.diff(key[order]) != 0
        rank[order] = np.cumsum(new) - 1
        reach *= 2
        if new.all() or reach >= n:
            return order


def matching_statistics(index: Index, text: np.ndarray, ends: np.ndarray, length: int, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the text up to each end: how far to the left (at most length) it has a second occurrence, and the interval of those that have length.

    times: the occurrences that the suffixes before each place of the array stand for.
    """
    n = len(ends)
    matched = np.zeros(n, np.int64)
    low, high = np.zeros(n, np.int64), np.full(n, len(text), np.int64)
    alive = np.arange(n)
    for k in range(length):
        a, b = index.extend(text[ends[alive] - 1 - k], low[alive], high[alive])
        ok = times[b] - times[a] > 1
        alive = alive[ok]
        low[alive], high[alive] = a[ok], b[ok]
        matched[alive] += 1
    return matched, low, high


def repeated(c: Contexts) -> np.ndarray:
    """Flags of all windows of the runs: whether the same words start earlier in the corpus."""
    n, total = len(c.count), int(c.count.sum())
    if not n:
        return np.zeros(0, bool)
    sizes = np.diff(c.at)
    names, number = np.unique(c.units, return_inverse=True)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.zeros(int(first[-1]), np.int64)
    owner = np.repeat(np.arange(n), sizes)
    text[first[owner] + np.arange(len(owner)) - c.at[owner]] = number + 1
    stops = first[1:] - 1
    ordered = text + n - 1
    ordered[stops] = np.arange(n)
    array = suffix_order(ordered)
    index = Index(text, array, len(names) + 1)
    run = np.repeat(np.arange(n), c.count)
    place = np.arange(total) - np.repeat(np.cumsum(c.count) - c.count, c.count)
    start = first[run] + place
    spot = np.repeat(np.arange(n), sizes + 1)
    times = np.concatenate(([0], np.cumsum(1 + c.several[spot[array]])))
    matched, low, high = matching_statistics(index, text, start + LENGTH, LENGTH, times)
    hit = np.flatnonzero(matched == LENGTH)
    flags = np.zeros(total, bool)
    if not len(hit):
        return flags
    # every place of the text by its order in the corpus
    inside = np.arange(len(text)) - first[spot]
    by = np.lexsort((c.low[spot] + inside, c.document[spot]))
    age = np.empty(len(text), np.int64)
    age[by] = np.arange(len(text))
    low, which = np.unique(low[hit], return_inverse=True)
    upto = np.zeros(len(low), np.int64)
    upto[which] = high[hit]
    cuts = np.stack((low, upto), 1).ravel()
    oldest = np.minimum.reduceat(np.append(age[array], np.iinfo(np.int64).max), cuts)[::2]
    flags[hit] = age[start[hit]] > oldest[which]
    return flags


SPEC = Spec(LENGTH, GRAM, by_words=True, keep_first=True, solve=repeated)


def removals(docs: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    Null and empty texts have no words; very long ones are treated whole. Rows of equal id and text are one document, so neither is earlier; rows
    of equal id and other text are ordered by a hash of the text; a null id is the lowest. Other columns are
    not looked at; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(unpacked(batch.column("__z")), batch.column("__spans").to_pylist(), strict=True):
                w = words(texts(pa.array([text], pa.large_binary())))
                gone = covered(spans, len(w.start), LENGTH)
                kept = b" ".join(text[a:b] for a, b in zip(w.start[~gone].tolist(), w.end[~gone].tolist(), strict=True))
                rows.append((len(w.start), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            if rows:
                a, b, h = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a), pa.array(b), pa.array(h)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return applied(docs, spec, ["doc_id"], run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string")
