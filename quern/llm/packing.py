"""Hierarchical multi-length packing of token streams.

Each task streams its documents in blocks of bounded size. Within a block, whole windows are cut
off long documents; what is left of each document is routed to the smallest context tier that
holds it; the tiers are packed from the longest down, each window's gap being filled with the
best-fitting documents of its own and shorter tiers and at last with a piece cut to measure. A block's windows of a
tier are dealt to step groups of about the same number of tokens whatever the tier, the costliest windows
first, each to the group with room that has the least attention cost (squared lengths of pieces) so
far. There is no shuffle, and no state but the block's: a lost task is simply run again.

Ids come from a byte-level BPE vocabulary in the ``tokenizers`` JSON format. They are computed
with ``tiktoken`` from the merge ranks in that file, which gives the same ids several times
faster; a test holds both against each other.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quern.llm.arrow import pieces

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 16 * 2048
BLOCK_TOKENS = 1 << 20
END_ID = 1

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint"
_FIELDS = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 stands for itself, others count up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to a uint32 array of ids, special strings handled as ``tokenizers`` does by default."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    made = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: made.encode_to_numpy(text, allowed_special="all")


class Block:
    """Documents' leftovers by tier, then the windows made of them: lists of (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.windows: list[list[tuple[int, int, int]]] = []
        #: For each tier the leftovers routed to it, as (length, document, start).
        self.routed: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}

    def add(self, document: int, n: int) -> None:
        whole = self.tiers[0]
        full = n - n % whole
        self.windows += [[(document, s, whole)] for s in range(0, full, whole)]
        if n > full:
            self.route((n - full, document, full))

    def route(self, piece: tuple[int, int, int]) -> None:
        self.routed[min(t for t in self.tiers if t >= piece[0])].append(piece)

    def pack(self) -> list[list[tuple[int, int, int]]]:
        """All windows; each holds as many tokens as a tier or, at the block's end, a power of two."""
        for pieces_of in self.routed.values():
            pieces_of.sort()
        for tier in self.tiers:
            while self.routed[tier]:
                window, room = [], tier
                while room and (piece := self._fitting(tier, room)):
                    window.append((piece[1], piece[2], piece[0]))
                    room -= piece[0]
                if room and (piece := self._shortest()):  # longer than the gap: cut to measure, what is left is routed anew
                    n, document, start = piece
                    window.append((document, start, room))
                    self._put_back((n - room, document, start + room))
                    room = 0
                self.windows += _by_powers(window) if room else [window]
        out, self.windows = self.windows, []
        return out

    def _fitting(self, tier: int, room: int) -> tuple[int, int, int] | None:
        """The longest piece of a tier and shorter ones that fits into the room."""
        for t in self.tiers[self.tiers.index(tier) :]:
            i = bisect_right(self.routed[t], (room, 1 << 62, 0)) - 1
            if i >= 0:
                return self.routed[t].pop(i)
        return None

    def _shortest(self) -> tuple[int, int, int] | None:
        return next((self.routed[t].pop(0) for t in reversed(self.tiers) if self.routed[t]), None)

    def _put_back(self, piece: tuple[int, int, int]) -> None:
        insort(self.routed[min(t for t in self.tiers if t >= piece[0])], piece)


def step_groups(windows: list[list[tuple[int, int, int]]], step_tokens: int) -> list[int]:
    """A group for each window: windows of one size, shares of them that differ by one at most, costs as even as a greedy deal makes them."""
    out, made = [0] * len(windows), 0
    by_size: dict[int, list[int]] = {}
    for i, window in enumerate(windows):
        by_size.setdefault(sum(n for _, _, n in window), []).append(i)
    for size, members in by_size.items():
        groups = -(-len(members) * size // max(step_tokens, size))
        fewest, more = divmod(len(members), groups)
        room = [fewest + (g < more) for g in range(groups)]
        heap = [(0, g) for g in range(groups)]
        cost = {i: sum(n * n for _, _, n in windows[i]) for i in members}
        for i in sorted(members, key=lambda i: (-cost[i], i)):
            total, g = heappop(heap)
            out[i] = made + g
            room[g] -= 1
            if room[g]:
                heappush(heap, (total + cost[i], g))
        made += groups
    return out


def _by_powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The last tokens of a block, cut where the sums reach the powers of two that they are made of."""
    total, out = sum(n for _, _, n in window), []
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    queue = window[::-1]
    for size in sizes:
        part: list[tuple[int, int, int]] = []
        while size:
            document, start, n = queue.pop()
            take = min(n, size)
            part.append((document, start, take))
            if take < n:
                queue.append((document, start + take, n - take))
            size -= take
        out.append(part)
    return out


def packed(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents (doc_id, text), packed into windows.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the
    window's tokens) and step_group (windows of one tier and block with step_tokens tokens together at most,
    evenly many in each). Null and empty texts have the end id alone; a very long text is one block with what
    came before it. Ties in length go by the order of rows. Rows with equal or
    null doc_id are packed each on its own. Other columns are not looked at. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 36
        made = steps = 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        block, held = Block(tiers), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, steps
            rows: list[tuple] = []
            windows = block.pack()
            groups = step_groups(windows, step_tokens)
            for window, step in zip(windows, groups, strict=True):
                size, group, offset = sum(n for _, _, n in window), base + steps + step, 0
                for document, start, n in window:
                    own = ids[document]
                    rows.append((names[document], start, n, zlib.crc32(own[start : start + n].astype("<u4").tobytes()), len(own), base + made, offset, size, group))
                    offset += n
                made += 1
            steps += max(groups, default=-1) + 1
            for i in range(0, len(rows), 20_000):
                columns = zip(*rows[i : i + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FIELDS)
            ids.clear()
            names.clear()

        for piece in pieces(batches, "text"):
            for name, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                own = np.append(encode(text or ""), np.uint32(END_ID))
                block.add(len(ids), len(own))
                ids.append(own)
                names.append(name)
                held += len(own)
                if held >= block_tokens:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)
