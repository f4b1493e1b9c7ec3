"""Runs of windows by anchor: how repeated windows of a corpus meet without moving all text.

Every window of ``length`` units (bytes, or word hashes) has an anchor: the rightmost of its
``gram``-unit runs with the lowest hash, which depends on the window's content alone. Consecutive
windows of a document with the same anchor are one run. Equal windows have equal anchor grams, at
the same distance from their start. So runs whose gram occurs once hold no repeated window; runs
of equal content hold the same windows; and only where a gram has runs of different content need
windows be compared, one run for each content.

Rows of equal id and text are one document. The identity of a document is its id (null: the lowest)
and a hash of its text; places are window starts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from quern.llm.arrow import ODD, mix, prefix_sums, range_hash

NO_ID = -(1 << 63)


class Runs(NamedTuple):
    """Runs of windows of some concatenated documents; positions are in the concatenation."""

    owner: np.ndarray  # document number
    low: np.ndarray  # first window start
    high: np.ndarray  # last window start
    anchor: np.ndarray
    gram: np.ndarray  # hash of the anchor's gram
    whole: np.ndarray  # hash of the run's content and the anchor's place in it


def runs(units: np.ndarray, at: np.ndarray, length: int, gram: int) -> Runs:
    """The runs of documents units[at[i]:at[i + 1]]; those shorter than length have none."""
    n = len(units)
    none = np.zeros(0, np.int64)
    if n < length or not (np.diff(at) >= length).any():
        return Runs(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    values = units if units.dtype == np.uint64 else mix(units.astype(np.uint64) + ODD)
    sums = prefix_sums(values)
    grams = n - gram + 1
    place = np.arange(grams)
    hashes = range_hash(sums, place, place + gram)
    key = (hashes >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - place.astype(np.uint64))
    lowest = _window_minimum(key, length - gram + 1)
    anchor = (np.uint64(0xFFFFFFFF) - (lowest & np.uint64(0xFFFFFFFF))).astype(np.int64)
    count = np.maximum(np.diff(at) - length + 1, 0)
    first = np.concatenate(([0], np.cumsum(count)))
    start = np.repeat(at[:-1], count) + np.arange(first[-1]) - np.repeat(first[:-1], count)
    owner = np.repeat(np.arange(len(count)), count)
    own = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(start)) - 1
    low, high, own = start[begin], start[end], own[begin]
    whole = mix(range_hash(sums, low, high + length) + (own - low).astype(np.uint64) * ODD)
    return Runs(owner[begin], low, high, own, hashes[own], whole)


def _window_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width consecutive values: running minima of blocks from both sides."""
    n = len(key)
    if width == 1:
        return key
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[:n] = key
    grid = grid.reshape(blocks, width)
    onward = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], onward[width - 1 : n])
