"""Windows that a corpus repeats: the passes that substring and suffix-array dedup share.

1. Each task cuts its documents into runs (``anchors``), sets aside what repeats among its own, and ships
   one run of each content, packed, to shards by gram: a content that a third of all documents have
   comes to its shard once a task, not once a document. A shard does the same with the runs of equal content
   that tasks sent, and asks for one run of each content that repeats, or whose gram has other contents too.
2. The runs asked for are read from their documents and shipped to the gram's shard, with a mark on those that
   stand for several. The shard builds its index over them and finds the repeated windows among them. Where a
   gram has more than ``Spec.hot`` contents, its windows go, as runs of one window, to the shard of their own hash,
   again once a task and content: no gram, however frequent, fills a shard's index.
3. What the index found, and the runs set aside as copies of those in it, is joined to the documents.

Texts travel compressed, twice. A shard holds what one of the session's shuffle partitions is
meant to hold. What passes between the steps is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.anchors import NO_ID, runs
from quern.llm.arrow import ODD, Texts, mix, pieces, prefix_sums, range_hash, texts, word_hashes, words
from quern.llm.spread import partitions, written

FLUSH = 1 << 18  # runs that a task holds before it ships them
PIECE = 1 << 19  # bytes of text whose runs are cut at once
FINE = 4  # indexes that a shard's runs are split into
SIEVE_BITS = 26  # the most that a bitmap of identities has, as a power of two: 8 MB
PLAIN, SEVERAL, DONE = 0, 1, 2  # an entry; one that stands for several; one that is a copy of such


class Contexts(NamedTuple):
    """Runs to compare: run i is units[at[i]:at[i + 1]], with windows from each of its first count[i] places."""

    units: np.ndarray
    at: np.ndarray
    count: np.ndarray
    anchor: np.ndarray  # the anchor's place in the run
    document: np.ndarray  # documents by order
    low: np.ndarray  # the run's place in its document
    several: np.ndarray  # whether the run stands for several of equal content


class Spec(NamedTuple):
    length: int
    gram: int
    by_words: bool
    keep_first: bool
    solve: Callable[[Contexts], np.ndarray]  # flags of all windows, run by run
    hot: int = 4096  # contents of a gram up to which its windows go to the index of the gram's shard


def identity(docs: DataFrame) -> tuple[Column, Column]:
    text = F.coalesce(docs["text"], F.lit(""))
    return F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("__id"), F.xxhash64(text).alias("__th")


def _units(t: Texts, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    if not by_words:
        return t.data, t.at
    w = words(t)
    return word_hashes(t, w), w.first


_BLOB = ("ids", "hashes", "owner", "low", "count", "anchor", "gram", "whole", "state")
_KINDS = ("<i8", "<i8", "<u4", "<u4", "<u2", "<u2", "<u4", "<u8", "u1")


def _ranks(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each document in the order of ids and hashes; equal ones share theirs."""
    order = np.lexsort((hashes, ids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(hashes[order]) != 0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def settled_here(document: np.ndarray, low: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries of one task: the first of each content, to ship, whether it stands for several, and the others."""
    order = np.lexsort((low, document, key))
    same = np.zeros(len(order), bool)
    same[1:] = np.diff(key[order]) == 0
    again = same.copy()
    again[1:] &= (np.diff(document[order]) == 0) & (np.diff(low[order]) == 0)
    order, same = order[~again], same[~again]
    head = np.flatnonzero(~same)
    return order[head], np.diff(np.append(head, len(order))) > 1, order[same]


def _blobs(shard: np.ndarray, ids: np.ndarray, hashes: np.ndarray, owner: np.ndarray, rest: list[np.ndarray], names: list[str], kinds: list[str], sizes: np.ndarray | None = None, content: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each shard with its entries packed; content goes along by entry."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        own, local = np.unique(owner[part], return_inverse=True)
        packed = [ids[own].astype("<i8"), hashes[own].astype("<i8"), local.astype("<u4"), *(x[part].astype(k) for x, k in zip(rest, kinds, strict=True))]
        columns = [pa.array([int(shard[part[0]])], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)]
        if content is not None:
            columns += [pa.array([sizes[part].astype("<u4").tobytes()], pa.binary()), pa.array([b"".join(content[i] for i in part.tolist())], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "ids", "hashes", "owner", *names, "sizes", "content"])
        else:
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "ids", "hashes", "owner", *names])


def _read(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and hashes of the shard's documents in order, and the document of each entry."""
    ids, hashes = _read(table, "ids", "<i8"), _read(table, "hashes", "<i8")
    order = np.lexsort((hashes, ids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(hashes[order]) != 0)
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    base, entries = 0, []
    for mine, owner in zip(table.column("ids"), table.column("owner"), strict=True):
        entries.append(np.frombuffer(owner.as_py(), "<u4").astype(np.int64) + base)
        base += len(mine.as_py()) // 8
    return ids[order][new], hashes[order][new], code[np.concatenate(entries)] if entries else code


def _settle(table: pa.Table, spec: Spec) -> pa.Table:
    """The shard's runs that are copies of earlier ones (asked is null), and those that its indexes need, as anchor | several << 16."""
    ids, hashes, document = _documents(table)
    low, count, anchor, gram, whole, state = (_read(table, n, k) for n, k in zip(_BLOB[3:], _KINDS[3:], strict=True))
    done = state == DONE
    before = {"__id": ids[document[done]], "__th": hashes[document[done]], "span": (low[done].astype(np.int64) << 16) | count[done]}
    document, low, count, anchor, gram, whole, state = (x[~done] for x in (document, low, count, anchor, gram, whole, state))
    order = np.lexsort((low, document, whole, gram))
    document, low, count, anchor, gram, whole, state = (x[order] for x in (document, low, count, anchor, gram, whole, state))
    same = np.zeros(len(order), bool)
    same[1:] = (gram[1:] == gram[:-1]) & (whole[1:] == whole[:-1])
    again = same.copy()
    again[1:] &= (document[1:] == document[:-1]) & (low[1:] == low[:-1])
    document, low, count, anchor, gram, state, same = (x[~again] for x in (document, low, count, anchor, gram, state, same))
    n = len(same)
    head = np.flatnonzero(~same)
    size = np.diff(np.append(head, n))
    several = (size > 1) | (np.maximum.reduceat(state, head) == SEVERAL) if n else size > 1
    new_gram = np.ones(len(head), bool)
    new_gram[1:] = gram[head[1:]] != gram[head[:-1]]
    which = np.cumsum(new_gram) - 1
    contents = np.bincount(which)[which] if len(which) else which
    wanted = (contents > 1) | several
    asked = head[wanted]
    shard = int(table.column("shard")[0].as_py())
    at = np.concatenate((np.flatnonzero(same), asked))
    where = np.where(contents[wanted] > spec.hot, -1, shard * FINE + (gram[asked] % FINE).astype(np.int64))
    known = len(before["span"]) + int(same.sum())
    ask = pa.array(np.concatenate((np.zeros(known, np.int64), where)), mask=np.arange(known + len(asked)) < known)
    columns = {"__id": ids[document[at]], "__th": hashes[document[at]], "span": (low[at].astype(np.int64) << 16) | count[at]}
    columns = {c: np.concatenate((before[c], columns[c])) for c in columns}
    marked = anchor[asked].astype(np.int32) | (several[wanted].astype(np.int32) << 16)
    return pa.table({**columns, "anchor": np.concatenate((np.zeros(known, np.int32), marked)), "asked": ask})


class Sieve:
    """A bitmap that the identities of some rows pass, and few others: sixteen bits a row up to a bound, beyond which more others pass."""

    def __init__(self, rows: DataFrame) -> None:
        self.spots = 1 << min(SIEVE_BITS, max(15, (16 * rows.count()).bit_length()))
        spot = self.spot(F.col("__id"), F.col("__th"))
        blocks = rows.groupBy(F.shiftright(spot, 15).alias("block")).agg(F.bitmap_construct_agg(spot.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).collect()
        self.bits = np.zeros((self.spots >> 15, 1 << 12), np.uint8)
        for r in blocks:
            self.bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)

    def spot(self, id: Column, hash: Column) -> Column:
        return F.xxhash64(id, hash).bitwiseAND(F.lit(self.spots - 1))

    def passes(self, spot: np.ndarray) -> np.ndarray:
        return (self.bits.ravel()[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)


def compressed(docs: DataFrame, keep: list[str], sieve: Sieve | None = None) -> DataFrame:
    """The kept columns, the identity and the text, compressed, of the rows that pass the sieve."""
    rows = docs.select(*identity(docs), *(docs[c] for c in keep), F.coalesce(docs["text"], F.lit("")).alias("text"))
    sent = rows.withColumn("__spot", sieve.spot(rows["__id"], rows["__th"])) if sieve else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        passed = (b.filter(pa.array(sieve.passes(b.column("__spot").to_numpy()))) for b in batches) if sieve else batches
        for piece in pieces(passed, "text"):
            t = texts(piece.column("text"))
            z = pa.array([pack(t.text(i)) for i in range(piece.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("__id", "__th", *keep)), z], names=["__id", "__th", *keep, "__z"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return sent.mapInArrow(run, f"{fields}, `__z` binary")


def unpacked(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in column.to_pylist()]


def unpackable(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of __z have about limit bytes together once they are unpacked, or are one text."""
    for batch in batches:
        size = np.cumsum([0, *(zstandard.frame_content_size(x.as_buffer()) for x in batch.column("__z"))])
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(size, size[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def spans(docs: DataFrame, spec: Spec) -> DataFrame:
    """__id, __th, spans: the repeated windows of each document that has any, as start << 16 | count."""
    shards = partitions(docs.sparkSession)
    rows = docs.select(*identity(docs), F.coalesce(docs["text"], F.lit("")).alias("text"))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ids: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        documents = entries = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                owner, low, count, anchor, gram, whole = (np.concatenate(x) for x in zip(*held, strict=True))
                every, each = np.concatenate(ids), np.concatenate(hashes)
                go, several, done = settled_here(_ranks(every, each)[owner], low, mix(gram) + whole)
                state = np.concatenate((several * np.uint8(SEVERAL), np.full(len(done), DONE, np.uint8)))
                shard = np.concatenate(((gram[go] % np.uint64(shards)).astype(np.int64), np.arange(len(done)) * shards // max(1, len(done))))
                pick = np.concatenate((go, done))
                rest = [low[pick], count[pick], anchor[pick], (gram[pick] // np.uint64(shards)) & np.uint64(0xFFFFFFFF), whole[pick], state]
                yield from _blobs(shard, every, each, owner[pick], rest, list(_BLOB[3:]), list(_KINDS[3:]))

        for piece in pieces(batches, "text", PIECE):
            units, at = _units(texts(piece.column("text")), spec.by_words)
            r = runs(units, at, spec.length, spec.gram)
            if len(r.owner):
                held.append((r.owner + documents, r.low - at[r.owner], r.high - r.low + 1, r.anchor - r.low, r.gram, r.whole))
            ids.append(piece.column("__id").to_numpy())
            hashes.append(piece.column("__th").to_numpy())
            documents += piece.num_rows
            entries += len(r.owner)
            if entries >= FLUSH:
                yield from flush()
                held, ids, hashes, documents, entries = [], [], [], 0, 0
        yield from flush()

    def settle(table: pa.Table) -> pa.Table:
        return _settle(table, spec)

    blob = "shard int, " + ", ".join(f"{n} binary" for n in _BLOB)
    known = written(rows.mapInArrow(ship, blob).groupBy("shard").applyInArrow(settle, "`__id` bigint, `__th` bigint, span bigint, anchor int, asked bigint"))

    asked = known.where("asked is not null").groupBy("__id", "__th").agg(F.collect_list(F.struct("span", "anchor", "asked")).alias("asked"))
    wanted = compressed(docs, []).join(asked, ["__id", "__th"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        ids, hashes = [], []
        entries: list[tuple] = []  # owner, shard, low, count, anchor, state; content goes along
        content: list[bytes] = []
        single: list[tuple[np.ndarray, ...]] = []  # windows dealt by their own hash: owner, low, anchor, hash, run, place in the run, whether it stands for several
        runs_of: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            every, each = np.array(ids, np.int64), np.array(hashes, np.int64)
            if single:
                own, low, anchor, h, run, place, many = (np.concatenate(x) for x in zip(*single, strict=True))
                go, several, done = settled_here(_ranks(every, each)[own], low, h)
                several |= np.isin(h[go], h[many])
                shard = (h % np.uint64(shards * FINE)).astype(np.int64)
                for i, more in zip(go.tolist(), several.tolist(), strict=True):
                    entries.append((own[i], shard[i], low[i], 1, anchor[i], SEVERAL if more else PLAIN))
                    content.append(runs_of[run[i]][place[i] : place[i] + spec.length].tobytes())
                for k, i in enumerate(done.tolist()):
                    entries.append((own[i], k * shards * FINE // len(done), low[i], 1, 0, DONE))
                    content.append(b"")
            if entries:
                owner, shard, *rest = (np.array(x) for x in zip(*entries, strict=True))
                yield from _blobs(shard, every, each, owner, rest, list(_RUN), list(_RUN_KINDS), np.array([len(x) for x in content]), content)

        for batch in batches:
            for i in range(batch.num_rows):
                name, th = batch.column("__id")[i].as_py(), batch.column("__th")[i].as_py()
                if (name, th) in seen:
                    continue
                seen.add((name, th))
                units, _ = _units(texts(pa.array(unpacked(batch.column("__z").slice(i, 1)), pa.large_binary())), spec.by_words)
                for x in batch.column("asked")[i].as_py():
                    begin, n = x["span"] >> 16, x["span"] & 0xFFFF
                    anchor, state = x["anchor"] & 0xFFFF, SEVERAL if x["anchor"] >> 16 else PLAIN
                    piece = units[begin : begin + n - 1 + spec.length]
                    if x["asked"] < 0:
                        sums = prefix_sums(piece if spec.by_words else mix(piece.astype(np.uint64) + ODD))
                        at = np.arange(n)
                        single.append((np.full(n, len(ids)), begin + at, anchor - at, range_hash(sums, at, at + spec.length), np.full(n, len(runs_of)), at, np.full(n, state == SEVERAL)))
                        runs_of.append(piece)
                        held += 64 * n
                        continue
                    entries.append((len(ids), x["asked"], begin, n, anchor, state))
                    content.append(piece.tobytes())
                    held += piece.nbytes
                ids.append(name)
                hashes.append(th)
                if held > 12 << 20:
                    yield from flush()
                    ids, hashes, entries, content, single, runs_of = [], [], [], [], [], []
                    held = 0
        yield from flush()

    def compare(table: pa.Table) -> pa.Table:
        return _compared(table, spec)

    blob = ", ".join(f"{n} {'int' if n == 'shard' else 'binary'}" for n in ("shard", "ids", "hashes", "owner", *_RUN, "sizes", "content"))
    found = wanted.mapInArrow(fetch, blob).groupBy("shard").applyInArrow(compare, "`__id` bigint, `__th` bigint, span bigint")
    both = known.where("asked is null").select("__id", "__th", "span").unionAll(found)
    return both.groupBy("__id", "__th").agg(F.collect_list("span").alias("__spans"))


_RUN = ("low", "count", "anchor", "state")
_RUN_KINDS = ("<u4", "<u2", "<u2", "u1")


def _compared(table: pa.Table, spec: Spec) -> pa.Table:
    """The repeated windows of a shard's runs, by its index, and the copies that tasks set aside."""
    ids, hashes, document = _documents(table)
    low, count, anchor, state, sizes = (_read(table, n, k).astype(np.int64) for n, k in zip((*_RUN, "sizes"), (*_RUN_KINDS, "<u4"), strict=True))
    units = _read(table, "content", "<u8" if spec.by_words else "u1")
    at = np.concatenate(([0], np.cumsum(sizes // units.itemsize)))
    done = np.flatnonzero(state == DONE)
    before = {"__id": ids[document[done]], "__th": hashes[document[done]], "span": (low[done] << 16) | count[done]}
    # a document that rows repeat in several partitions comes once
    order = np.flatnonzero(state != DONE)
    order = order[np.lexsort((low[order], document[order]))]
    keep = np.ones(len(order), bool)
    keep[1:] = (np.diff(document[order]) != 0) | (np.diff(low[order]) != 0)
    if len(done) or not keep.all():
        order = order[keep]
        units = np.concatenate([units[at[i] : at[i + 1]] for i in order]) if len(order) else units[:0]
        at = np.concatenate(([0], np.cumsum((sizes // units.itemsize)[order])))
        document, low, count, anchor, state = (x[order] for x in (document, low, count, anchor, state))
    flags = spec.solve(Contexts(units, at, count, anchor, document, low, state == SEVERAL))
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + low[owner]
    new = flags.copy()
    new[1:] &= ~(flags[:-1] & (owner[1:] == owner[:-1]))
    begin = np.flatnonzero(new)
    total = np.concatenate(([0], np.cumsum(flags)))
    n = np.diff(np.append(total[begin], total[-1]))
    found = {"__id": ids[document[owner[begin]]], "__th": hashes[document[owner[begin]]], "span": (place[begin] << 16) | n}
    return pa.table({c: np.concatenate((before[c], found[c])) for c in before})


def covered(packed: list[int] | None, n: int, length: int) -> np.ndarray:
    """Which of n units the windows cover."""
    edge = np.zeros(n + 1, np.int64)
    if packed:
        x = np.array(packed, np.int64)
        np.add.at(edge, x >> 16, 1)
        np.add.at(edge, (x >> 16) + (x & 0xFFFF) - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def applied(docs: DataFrame, spec: Spec, keep: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over all rows: the kept columns, __z (compressed text) and __spans (null: none)."""
    rows = compressed(docs, keep).join(spans(docs, spec), ["__id", "__th"], "left").drop("__id", "__th")

    return rows.mapInArrow(lambda batches: run(unpackable(batches)), schema)
