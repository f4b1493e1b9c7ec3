"""Suffix-array dedup: bytes that a 200-byte string covers which also starts elsewhere.

The runs of ``repeats`` meet in shards. A shard's runs are laid on a grid of 16-byte blocks that
starts at their anchors, so equal windows have equal blocks; the blocks, named by rank, are the
text that the suffix array is built over. The array is built by grouping suffixes by their
Lyndon prefixes: groups are processed in descending order, each lengthening the prefixes of the
suffixes that its members point to as previous smaller ones; a second pass emits each group's order.
A window has 11 or 12 whole blocks of 16 bytes: suffixes that share that many stand together in the array, and
the bytes left at both ends tell windows of such a stretch apart, so the result is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.repeats import Contexts, Spec, applied, covered, unpacked
from quern.llm.spread import neutral

LENGTH = 200
GRAM = 64
BLOCK = 16
#: The lowest k bytes of a word, for k from 0 to 8.
LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _counted(symbols: np.ndarray) -> np.ndarray:
    """Places by ascending symbols: 16 bits at a time, each pass a counting sort."""
    order = np.arange(len(symbols))
    for shift in range(0, max(1, int(symbols.max(initial=0)).bit_length()), 16):
        order = order[np.argsort((symbols[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes in ascending order; the last symbol must be the only lowest one.

    Group numbers are places in the array: a group of k suffixes with number g has the places g to
    g + k - 1, so comparing numbers compares groups, and splitting one keeps the others' numbers.
    """
    n = len(text)
    order = _counted(np.array(text)).tolist()
    group, where, size = [0] * n, [0] * n, {}
    start = 0
    for place, i in enumerate(order):
        if place and text[i] != text[order[place - 1]]:
            start = place
        group[i], where[i] = start, place
        size[start] = size.get(start, 0) + 1
    previous, known = [-1] * n, [False] * n
    end = n
    while end > 0:
        # the highest group that hasn't been processed ends before place end
        g = group[order[end - 1]]
        members = order[g:end]
        end = g
        found: dict[int, int] = {}
        for i in members:
            if known[i]:
                continue
            # members that stand between i and its previous smaller one come first, from the left
            waiting, j = [i], i - 1
            while waiting:
                while j >= 0 and (known[j] or group[j] > g):
                    j = previous[j]
                if j >= 0 and group[j] == g:
                    waiting.append(j)
                    j -= 1
                    continue
                i = waiting.pop()
                previous[i], known[i] = j, True
                if j >= 0:
                    found[j] = found.get(j, 0) + 1
        # suffixes that more members point to have higher prefixes; each lot leaves its group for a new one after it
        by_count: dict[int, list[int]] = {}
        for j, times in found.items():
            by_count.setdefault(times, []).append(j)
        for times in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            lot = by_count[times]
            for j in lot:
                old = group[j]
                last = old + size[old] - 1 - moved.get(old, 0)
                moved[old] = moved.get(old, 0) + 1
                other, place = order[last], where[j]
                order[place], order[last] = other, j
                where[other], where[j] = place, last
            for old, k in moved.items():
                if k < size[old]:
                    size[old] -= k
                    new = old + size[old]
                    size[new] = k
                    for place in range(new, new + k):
                        group[order[place]] = new
    # emit: from each suffix on, all that point to it as next smaller one come next in their groups
    front = dict.fromkeys(size, 0)
    done = [False] * n
    out = [-1] * n
    out[0] = n - 1
    done[n - 1] = True
    for place in range(n):
        j = out[place] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[g + front[g]] = j
            front[g] += 1
            done[j] = True
            j = previous[j]
    return out


def repeated(c: Contexts) -> np.ndarray:
    """Flags of all windows of the runs: whether another window has the same bytes."""
    n = len(c.count)
    total = int(c.count.sum())
    if not n:
        return np.zeros(0, bool)
    sizes = np.diff(c.at)
    before = (-c.anchor) % BLOCK
    blocks = -(-(before + sizes) // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks + 1)))  # a separator after each run
    grid = np.zeros((int(first[-1]), BLOCK), np.uint8)
    flat = grid.reshape(-1)
    owner = np.repeat(np.arange(n), sizes)
    flat[first[owner] * BLOCK + before[owner] + np.arange(len(owner)) - c.at[owner]] = c.units
    high, low = flat.view(">u8").astype(np.uint64).reshape(-1, 2).T
    order = np.lexsort((low, high))
    symbol = np.empty(len(order), np.int64)
    symbol[order] = np.cumsum(np.concatenate(([False], (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0))))
    symbol = symbol + 2
    symbol[first[1:] - 1] = 1
    symbol = np.append(symbol, 0)
    array = np.array(suffix_array(symbol.tolist()), np.int64)
    most = LENGTH // BLOCK
    padded = np.concatenate((symbol, np.zeros(most, symbol.dtype)))
    shared = np.zeros(len(array), np.int64)
    alive = np.arange(1, len(array))
    for k in range(most):
        alive = alive[padded[array[alive] + k] == padded[array[alive - 1] + k]]
        shared[alive] += 1
    stretch = []
    for whole in (most - 1, most):
        number = np.empty(len(array), np.int64)
        number[array] = np.cumsum(shared < whole)
        stretch.append(number)
    run = np.repeat(np.arange(n), c.count)
    place = np.arange(total) - np.repeat(np.cumsum(c.count) - c.count, c.count)
    distance = c.anchor[run] - place
    left = distance // BLOCK
    part = distance % BLOCK
    head = first[run] + (before + c.anchor)[run] // BLOCK - left
    whole = (LENGTH - part) // BLOCK
    rest = LENGTH - part - whole * BLOCK
    number = np.where(whole == most, stretch[1][head], stretch[0][head])
    # the bytes before the first whole block and after the last
    high, low = (np.append(x, np.zeros(most + 2, np.uint64)) for x in (high, low))
    ahead, after = np.maximum(head - 1, 0), head + whole
    ends = [high[ahead] & LOWEST[np.maximum(part - 8, 0)], low[ahead] & LOWEST[np.minimum(part, 8)], high[after] & ~LOWEST[8 - np.minimum(rest, 8)], low[after] & ~LOWEST[8 - np.maximum(rest - 8, 0)]]
    order = np.lexsort((*ends, part, number))
    same = np.ones(len(order) - 1, bool)
    for x in (number, part, *ends):
        same &= np.diff(x[order]) == 0
    # windows of one stretch, by how many they stand for
    head = np.flatnonzero(np.concatenate(([True], ~same)))
    times = np.add.reduceat(1 + c.several[run[order]], head)
    flags = np.zeros(total, bool)
    flags[order] = np.repeat(times > 1, np.diff(np.append(head, total)))
    return flags


SPEC = Spec(LENGTH, GRAM, by_words=False, keep_first=False, solve=repeated)


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    for text, spans in zip(unpacked(batch.column("__z")), batch.column("__spans").to_pylist(), strict=True):
        yield text, covered(spans, len(text), LENGTH)


def removals(docs: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null texts count as empty; texts of fewer than 200 bytes lose nothing; very long ones are treated whole. Rows of equal id and text are
    one document, each row with its result; rows of equal id and other text are others. A null id is
    an id. Other columns are not looked at; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, gone in _kept(batch):
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                begins = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), len(text) - len(kept), begins, hashlib.sha256(kept).hexdigest()))
            if rows:
                a, b, n, h = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a), pa.array(b), pa.array(n), pa.array(h)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return applied(docs, spec, ["doc_id"], run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows with their columns, whatever their names, the text without its repeated bytes, and n_chars, if there, to match.

    A code point that loses some of its bytes loses all. Null texts stay null, empty ones empty; texts of fewer
    than 200 bytes lose nothing; very long ones are treated whole. Rows of equal id and text are one document, each
    with its result. An empty table gives none.
    """
    plain = neutral(docs)
    keep = [c for c in plain.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [np.frombuffer(text, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") for text, gone in _kept(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["__null", *keep]), pa.array(new, pa.string())], names=["__null", *keep, "text"])

    marked = plain.withColumn("__null", F.col("text").isNull())
    fields = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in keep)
    rows = applied(marked, SPEC, ["__null", *keep], run, f"`__null` boolean, {fields}, text string")
    rows = rows.withColumn("text", F.when(~F.col("__null"), F.col("text"))).select(*plain.columns).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return rows
