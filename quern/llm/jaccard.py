"""Jaccard links of shingle sets by PartEnum signatures: exact up to collisions of 63-bit names and 40-bit elements.

Sets are compared by size band: a band's sets lie within the similarity of its lowest size, so linked
sets are in one band or in neighbours, and each set takes part in its own band's instance and in
the next one's. In an instance, linked sets differ in at most k elements. The domain is hashed into blocks
of about ``BLOCK`` elements, so in some block linked sets differ in at most k' = k / blocks. A block is
hashed into n1 = ceil((k' + 1) / 2) partitions of two halves: some partition differs in one element at
most, so one of its halves not at all, and the sets share the signature (block, partition, half, the
half's elements). A half without elements says little; the signature is then taken of the other half,
whole and with each element left out (it differs in one element at most), and where that says
nothing either, of each half of the block under a second partitioning.

Equal sets are one set from the start. Sets that share a signature are candidates; they are
discarded by size and by the parities of hashed element counts (which differ in no more places than
the sets do, and of which there is one for each element), and what is left is compared element by element.
First each set is compared with the lowest one of each of its groups, along forests: in each round every
component tries its lowest untried neighbours, so a class of n alike sets costs about n comparisons.
Then groups that still have sets of several components are compared within the task that holds their elements,
in blocks of a bounded number of bytes and of two such blocks; no pair becomes a row, only links that
join two components do, fewer than a block pair has sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.anchors import NO_ID
from quern.llm.arrow import ODD, mix, pieces, shingle_hashes, texts, word_hashes, words
from quern.llm.repeats import Sieve, compressed, identity, unpackable, unpacked
from quern.llm.spread import freed as written
from quern.llm.spread import neutral, partitions

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5  # linked: intersection / union >= 4/5
BLOCK = 128
LEAST_PARITIES = 512
SHARD_ROWS = 1 << 15  # group members that a task compares
BLOCK_BYTES = 1 << 20  # of elements in a block of a group
HOME_ROWS = 1 << 13  # members of a home that stay together
HOME_BYTES = 2 << 20  # of elements of a home that stay together
SHARD_BYTES = 8 << 20  # of elements that a task compares
WHOLE_GROUP = 2048  # members up to which a group is looked through at once
ELEMENT = 5  # bytes
FLUSH_SIGNATURES = 3 << 18


@lru_cache(maxsize=1)
def _bands() -> np.ndarray:
    """The lowest size of each band."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * DENOMINATOR // NUMERATOR + 1)
    return np.array(low, np.int64)


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The elements in which linked sets of sizes a and b differ at most."""
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    t = texts(column)
    w = words(t)
    h, at = shingle_hashes(word_hashes(t, w, lower=True), w.first, SHINGLE)
    found = [np.unique(h[a:b]) for a, b in zip(at, at[1:], strict=False)]
    size = np.array([len(x) for x in found], np.int64)
    return (np.concatenate(found) if found else h), np.concatenate(([0], np.cumsum(size)))


def keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h))))
    return (mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * ODD) >> np.uint64(1)).astype(np.int64)


class Plan:
    """How an instance's sets are cut: places of halves, numbered over all sets."""

    def __init__(self, band: np.ndarray, owner: np.ndarray) -> None:
        top = _bands()[band + 1] - 1
        self.owner = owner
        self.blocks = np.maximum(1, top // BLOCK)
        self.halves = 2 * -(-(_bound(top, top) // self.blocks + 1) // 2)  # of a block
        self.code = mix(band.astype(np.uint64) * ODD + np.uint64(11))
        self.offset = np.concatenate(([0], np.cumsum(self.blocks * self.halves)))
        self.holder = np.repeat(np.arange(len(band)), self.blocks * self.halves)

    def hashed(self, h: np.ndarray, owner: np.ndarray, salt: int) -> np.ndarray:
        """The half that each element falls in."""
        block = mix(h ^ self.code[owner]) % self.blocks[owner].astype(np.uint64)
        half = mix((h ^ self.code[owner]) + np.uint64(salt)) % self.halves[owner].astype(np.uint64)
        return self.offset[owner] + (block.astype(np.int64) * self.halves[owner] + half.astype(np.int64))


def signatures(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets and the set of each."""
    out, sets_of = [], []
    size = np.diff(at)
    live = np.flatnonzero(size)
    if not len(live):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = np.searchsorted(_bands(), size[live], "right") - 1
    owner = np.repeat(np.arange(len(live)), size[live])  # empty sets have no elements
    weight = mix(h + ODD)

    def put(signature: np.ndarray, of: np.ndarray) -> None:
        out.append(mix(signature))
        sets_of.append(of)

    for ahead in (0, 1):
        plan = Plan(own + ahead, owner)
        n, holder = int(plan.offset[-1]), plan.holder
        where = plan.hashed(h, owner, 1)
        total = np.zeros(n, np.uint64)
        np.add.at(total, where, weight)
        count = np.bincount(where, minlength=n)
        inner = np.arange(n) - plan.offset[holder]
        place = mix(plan.code[holder] + inner.astype(np.uint64) * ODD)
        full = count > 0
        put(place[full] + total[full], holder[full])
        # halves without elements: what their partners hold, whole and less one element
        bare = np.flatnonzero(~full)
        partner = plan.offset[holder[bare]] + (inner[bare] ^ 1)
        other = place ^ np.uint64(0x5555)
        some = count[partner] > 0
        put(other[bare[some]] + total[partner[some]], holder[bare[some]])
        reached = np.zeros(n, bool)
        reached[partner[count[partner] > 1]] = True
        each = np.flatnonzero(reached[where])
        twin = plan.offset[owner[each]] + ((where[each] - plan.offset[owner[each]]) ^ 1)
        put(other[twin] + total[where[each]] - weight[each], holder[twin])
        # the partner has one element or none: every half of the block under the second partitioning
        vague = bare[count[partner] <= 1]
        if len(vague):
            used = np.zeros(len(live), bool)
            used[holder[vague]] = True
            again = np.flatnonzero(used[owner])
            second = np.zeros(n, np.uint64)
            np.add.at(second, plan.hashed(h[again], owner[again], 2), weight[again])
            wide = plan.halves[holder[vague]]
            v = np.repeat(np.arange(len(vague)), wide)
            k = np.arange(len(v)) - np.repeat(np.cumsum(wide) - wide, wide)
            mine = holder[vague[v]]
            begin = inner[vague[v]] // plan.halves[mine] * plan.halves[mine]
            put(mix((place[vague[v]] ^ np.uint64(0xAAAA)) + k.astype(np.uint64) * ODD) + second[plan.offset[mine] + begin + k], mine)
    return np.concatenate(out), live[np.concatenate(sets_of)]


def parities(h: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements falls in each of as many places or more, a power of two, as bytes."""
    n = max(LEAST_PARITIES, 1 << (len(h) - 1).bit_length() if len(h) else 0)
    return np.packbits(np.bincount((mix(h ^ ODD) & np.uint64(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1, bitorder="little")


def folded(parity: bytes, size: int) -> np.ndarray:
    """The parities over fewer places."""
    out = np.frombuffer(parity, np.uint64)
    while out.nbytes > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _candidates(rows: DataFrame, shards: int) -> DataFrame:
    """grp, low, size, key: the sets that share a signature, where several do, with the lowest of them and their number; groups of the same sets are one. rows: text."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys: list[np.ndarray] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = entries = 0
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sig, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            names = np.concatenate(held_keys)
            shard = (sig % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard * len(names) + owner, kind="stable")
            rest = ((sig // np.uint64(shards)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                own, count = np.unique(owner[part], return_counts=True)
                packed = (names[own].astype("<i8"), count.astype("u1" if count.max() < 256 else "<u4"), rest[part])
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[part[0]])], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["shard", "keys", "count", "sig"])

        for piece in pieces(batches, "text", 1 << 19):
            h, at = sets(piece.column("text"))
            name = keys(h, at)
            fresh = []
            for i, k in enumerate(name.tolist()):
                if k not in seen and at[i + 1] > at[i]:
                    seen.add(k)
                    fresh.append(i)
            if fresh:
                pick = np.concatenate([np.arange(at[i], at[i + 1]) for i in fresh])
                sig, owner = signatures(h[pick], np.concatenate(([0], np.cumsum(np.diff(at)[fresh]))))
                if held and (n + len(fresh) > 1 << 16 or entries + len(sig) > FLUSH_SIGNATURES):
                    yield from flush()
                    held, held_keys, n, entries = [], [], 0, 0
                held.append((sig, (owner + n).astype(np.int32)))
                held_keys.append(name[fresh])
                n += len(fresh)
                entries += len(sig)
            if len(seen) > 1 << 18:
                seen.clear()
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(x.as_py() for x in table.column("sig")), "<u4")
        key = np.concatenate([np.repeat(np.frombuffer(k, "<i8"), np.frombuffer(n, f"<u{8 * len(n) // len(k)}")) for k, n in zip(table.column("keys").to_pylist(), table.column("count").to_pylist(), strict=True)])
        order = np.argsort(sig, kind="stable")
        twice = np.zeros(len(sig), bool)
        same = np.diff(sig[order]) == 0
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        sig, key = sig[twice], key[twice]
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        new = np.ones(len(sig), bool)
        new[1:] = (np.diff(sig) != 0) | (np.diff(key) != 0)
        sig, key = sig[new], key[new]
        head = np.ones(len(sig), bool)
        head[1:] = np.diff(sig) != 0
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(sig)))
        if not (size > 1).any():
            return pa.table({"grp": pa.array([], pa.int64()), "members": pa.array([], pa.binary())})
        content = (mix(np.add.reduceat(mix(key.astype(np.uint64)), begin) + size.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        content, once = np.unique(np.where(size > 1, content, -1), return_index=True)
        content, once = content[content >= 0], once[content >= 0]
        members = [key[begin[i] : begin[i] + size[i]].tobytes() for i in once.tolist()]
        return pa.table({"grp": content, "members": pa.array(members, pa.binary())})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x.as_py(), "<i8") for x in batch.column("members")]
            if parts:
                size = np.array([len(x) for x in parts])
                of = (batch.column("grp").to_numpy(), np.array([x[0] for x in parts]), size)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(x, size)) for x in of), pa.array(np.concatenate(parts))], names=["grp", "low", "size", "key"])

    blobs = rows.mapInArrow(ship, "shard int, keys binary, count binary, sig binary")
    return blobs.groupBy("shard").applyInArrow(meet, "grp bigint, members binary").dropDuplicates(["grp"]).mapInArrow(spread, "grp bigint, low bigint, size bigint, key bigint")


def _allowed(size: np.ndarray, root: np.ndarray, parity: np.ndarray, i: int) -> np.ndarray:
    """Which of the sets after the i-th are in other components than it, and may be linked with it by size and parities."""
    rest = slice(i + 1, None)
    small, large = np.minimum(size[i], size[rest]), np.maximum(size[i], size[rest])
    ok = (root[rest] != root[i]) & (large * NUMERATOR <= small * DENOMINATOR)
    ok[ok] = np.bitwise_count(parity[rest][ok] ^ parity[i]).sum(1) <= _bound(size[i], size[rest][ok])
    return ok


def _parities(column: list[bytes]) -> np.ndarray:
    """Parities of several sets over the same places."""
    width = min(map(len, column))
    return np.stack([folded(x, width) for x in column])


def _dealt(rows: DataFrame, weight: Column, most: int, shards: int) -> DataFrame:
    """The rows with a shard: those of one home go together, but where they weigh more than most they are dealt by unit over parts."""
    parts = (1 + F.sum(weight) / most).cast("int")
    wide = rows.groupBy(F.col("home").alias("of")).agg(parts.alias("parts")).where("parts > 1")  # at most a row for each most that all rows weigh
    part = F.coalesce(F.pmod(F.xxhash64("unit"), F.col("parts")), F.lit(0))
    return rows.join(F.broadcast(wide), rows["home"] == wide["of"], "left").withColumn("shard", F.pmod(F.xxhash64("home", part), F.lit(shards)).cast("int")).drop("of", "parts")


def _stars(groups: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """a, b (a < b): each group's lowest member with those that size and parities allow; or grp, if others may be linked as well.

    groups: grp, low, size, key; known: key, n, parity. A group of more than WHOLE_GROUP is dealt by hash, its lowest member to all its parts.
    Groups of one lowest member go to one task, which gets the parities of a set once.
    """
    split = F.col("size") > WHOLE_GROUP
    part = F.when(split, F.pmod(F.xxhash64("key"), (1 + F.col("size") / WHOLE_GROUP).cast("int"))).otherwise(0)
    dealt = groups.where(~(split & (F.col("key") == F.col("low")))).select("grp", "key", "low", split.alias("split"), part.cast("int").alias("part"))
    dealt = dealt.withColumn("unit", F.xxhash64("grp", "part")).withColumn("home", F.when(F.col("split"), F.col("unit")).otherwise(F.col("low")))
    dealt = _dealt(dealt, F.lit(1), HOME_ROWS, shards).select("shard", "grp", "part", "key", F.when(F.col("split"), F.col("low")).alias("low"))
    needed = dealt.select(F.col("shard").alias("to"), F.col("key").alias("set")).unionAll(dealt.where("low is not null").select("shard", "low")).distinct()
    needed = needed.join(known.select(F.col("key").alias("set"), "n", "parity"), "set")

    def pairs(table: pa.Table, sets_of: pa.Table) -> pa.Table:
        place = {k: i for i, k in enumerate(sets_of.column("set").to_pylist())}
        size, raw = sets_of.column("n").to_numpy(), sets_of.column("parity").to_pylist()
        grp, part, key = (table.column(c).to_numpy() for c in ("grp", "part", "key"))
        low = table.column("low").to_pylist()
        order = np.lexsort((key, part, grp))
        cut = (np.diff(grp[order]) != 0) | (np.diff(part[order]) != 0)
        out: list[np.ndarray] = []
        more: list[int] = []
        for rows in np.split(order, np.flatnonzero(cut) + 1):
            if not len(rows):
                continue
            first = rows[0]
            dealt_out = low[first] is not None
            if not dealt_out and len(rows) < 2:
                continue
            keys = np.append(low[first], key[rows]) if dealt_out else key[rows]
            at = [place[k] for k in keys.tolist()]
            sizes, parity = size[at], _parities([raw[i] for i in at])
            ok = _allowed(sizes, keys, parity, 0)
            if ok.any():
                out.append(np.stack((np.full(int(ok.sum()), keys[0]), keys[1:][ok])))
            if dealt_out or any(_allowed(sizes, keys, parity, i).any() for i in range(1, len(keys) - 1)):
                more.append(int(grp[first]))
        found = np.unique(np.concatenate(out, 1), axis=1) if out else np.zeros((2, 0), np.int64)
        n, k = found.shape[1], len(more)
        lone = np.arange(n + k) >= n
        columns = [pa.array(np.concatenate((x, np.zeros(k, np.int64))), mask=lone) for x in found]
        return pa.table({"a": columns[0], "b": columns[1], "grp": pa.array(np.concatenate((np.zeros(n, np.int64), np.array(more, np.int64))), mask=~lone)})

    return dealt.groupBy("shard").cogroup(needed.groupBy("to")).applyInArrow(pairs, "a bigint, b bigint, grp bigint").distinct()


def _like(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * DENOMINATOR >= NUMERATOR * (len(x) + len(y) - both)


def _open(members: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """unit, key, n, root, second, mixed, home: the members that may be linked with another component's, as far as sizes and parities tell.

    members: grp, key, n, root, low (its lowest root), total (its elements); known: key, parity. A group's members are dealt by hash over as many
    blocks as their elements fill; each block, and each pair of blocks, is a unit of work. Units of much the same sets have their lowest component
    in common and go to one task, which gets the parities of a set once. home is the lowest of the components that are left in the unit, or the unit
    itself in a group of several blocks.
    """
    blocks = (1 + F.col("total") * ELEMENT / BLOCK_BYTES).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit, split = F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")), F.col("blocks") > 1
    dealt = dealt.select(unit.alias("unit"), "key", "n", "root", (F.col("own") > F.col("other")).alias("second"), (F.col("own") != F.col("other")).alias("mixed"), split.alias("split"), F.when(split, unit).otherwise(F.col("low")).alias("home"))
    dealt = written(_dealt(dealt, F.lit(1), HOME_ROWS, shards).drop("home"))

    def involved(table: pa.Table, sets_of: pa.Table) -> pa.Table:
        place = {k: i for i, k in enumerate(sets_of.column("set").to_pylist())}
        raw = sets_of.column("parity").to_pylist()
        unit, key, size, root, second, mixed, split = (table.column(c).to_numpy() for c in ("unit", "key", "n", "root", "second", "mixed", "split"))
        order = np.lexsort((key, unit))
        keep, home = np.zeros(len(order), bool), unit.copy()
        for part in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            if (root[part] == root[part[0]]).all():
                continue
            parity = _parities([raw[place[k]] for k in key[part].tolist()])
            for i in range(len(part) - 1):
                ok = _allowed(size[part], root[part], parity, i)
                if mixed[part[0]]:
                    ok &= second[part[i + 1 :]] != second[part[i]]
                keep[part[i + 1 :][ok]] = True
                keep[part[i]] |= ok.any()
            if not split[part[0]] and keep[part].any():
                home[part] = root[part[keep[part]]].min()
        return table.drop_columns(["shard", "split"]).append_column("home", pa.array(home)).filter(pa.array(keep))

    needed = dealt.select(F.col("shard").alias("to"), F.col("key").alias("set")).distinct()
    needed = needed.join(known.select(F.col("key").alias("set"), "parity"), "set")
    fields = "unit bigint, key bigint, n bigint, root bigint, second boolean, mixed boolean, home bigint"
    return dealt.groupBy("shard").cogroup(needed.groupBy("to")).applyInArrow(involved, fields)


def _rest(found: DataFrame, known: DataFrame, elements: DataFrame) -> DataFrame:
    """low, high: links between components, enough to join all that the units' members join. found: as _open gives it; known: key, parity; elements: key, elements."""
    shards = 1 + (found.agg(F.sum("n")).first()[0] or 0) * ELEMENT // SHARD_BYTES
    dealt = _dealt(found, F.col("n") * ELEMENT, HOME_BYTES, shards).drop("home")

    def links(table: pa.Table, sets_of: pa.Table) -> pa.Table:
        place = {k: i for i, k in enumerate(sets_of.column("set").to_pylist())}
        unit, key, size, root, second, mixed = (table.column(c).to_numpy() for c in ("unit", "key", "n", "root", "second", "mixed"))
        raw, held = sets_of.column("parity").to_pylist(), sets_of.column("elements")
        read = lru_cache(maxsize=None)(lambda k: _unpacked(held[place[k]]))
        alike = lru_cache(maxsize=1 << 18)(lambda a, b: _like(read(a), read(b)))
        order = np.lexsort((key, unit))
        out: list[tuple[int, int]] = []
        for part in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            comp = root[part].copy()
            if (comp == comp[0]).all():
                continue
            own = key[part].tolist()
            parity, sizes, side = _parities([raw[place[k]] for k in own]), size[part], second[part]
            for i in range(len(part) - 1):
                ok = _allowed(sizes, comp, parity, i)
                if mixed[part[0]]:
                    ok &= side[i + 1 :] != side[i]
                for j in np.flatnonzero(ok) + i + 1:
                    if comp[i] != comp[j] and alike(own[i], own[j]):
                        low, high = sorted((int(comp[i]), int(comp[j])))
                        out.append((low, high))
                        comp[comp == high] = low
        low, high = zip(*out, strict=True) if out else ((), ())
        return pa.table({"low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

    # a set that several units of a shard need goes there once
    needed = dealt.select(F.col("shard").alias("to"), F.col("key").alias("set")).distinct()
    needed = needed.join(known.select(F.col("key").alias("set"), "parity"), "set").join(elements.select(F.col("key").alias("set"), "elements"), "set")
    return dealt.groupBy("shard").cogroup(needed.groupBy("to")).applyInArrow(links, "low bigint, high bigint").distinct()


def _packed(h: np.ndarray) -> bytes:
    """The upper 40 bits of ascending hashes."""
    return (h >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(x: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def _linked(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """The pairs whose sets are linked, by all their elements. pairs: a, b and more; elements: key, elements."""
    kept = pairs.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                ok.append(_like(_unpacked(x), _unpacked(y)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept], names=kept).filter(pa.array(ok, pa.bool_()))

    x = elements.select(F.col("key").alias("a"), F.col("elements").alias("x"))
    y = elements.select(F.col("key").alias("b"), F.col("elements").alias("y"))
    # joined apart, so that where the pairs are few no side moves sets that aren't in them
    both = pairs.join(x, "a").join(pairs.select("a", "b").join(y, "b"), ["a", "b"])
    return both.select(*kept, "x", "y").mapInArrow(compare, pairs.schema)


def _merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (key, root) after joining the components of each edge (low < high, both roots).

    Every component takes the lowest it has an edge to as parent; parents are followed to their ends by
    doubling; edges whose ends still differ go another round.
    """
    while True:
        up = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("parent"))
        up = written(up)
        while True:
            above = up.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            up = written(up.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
            moved = up.where("moved").limit(1).count()
            up = up.drop("moved")
            if not moved:
                break
        roots = written(roots.join(up.withColumnRenamed("node", "root"), "root", "left").select("key", F.coalesce("parent", "root").alias("root")))
        one, two = (up.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root")) for c in ("low", "high"))
        edges = edges.join(one, "low", "left").join(two, "high", "left").select(F.coalesce("low_root", "low").alias("p"), F.coalesce("high_root", "high").alias("q"))
        edges = written(edges.where("p <> q").select(F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")).distinct())
        if edges.isEmpty():
            return roots


def _grown(roots: DataFrame, pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """roots after trying pairs until none joins two components: each round tries up to 1, 8, 64 ... of each component's."""
    most = 1
    while True:
        one, two = (roots.select(F.col("key").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
        open_pairs = pairs.join(one, "a").join(two, "b").where("ra <> rb").select("a", "b", F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high"))
        open_pairs = written(open_pairs)
        if open_pairs.isEmpty():
            return roots
        slot = F.pmod(F.xxhash64("a", "b"), F.lit(most)).alias("slot")
        tried = written(open_pairs.groupBy("high", slot).agg(F.min(F.struct("low", "a", "b")).alias("t")).select("t.a", "t.b", "t.low", "high"))
        good = written(_linked(tried, elements))
        if not good.isEmpty():
            roots = _merged(roots, good.select("low", "high").distinct())
        pairs = open_pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
        most *= 8


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: __id, __th, key, n of every row; key, root of the sets that have candidates."""
    shards = partitions(docs.sparkSession)
    rows = docs.select(*identity(docs), F.coalesce(docs["text"], F.lit("")).alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            h, at = sets(piece.column("text"))
            parity = pa.array([parities(h[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("__id"), piece.column("__th"), pa.array(keys(h, at)), pa.array(np.diff(at)), parity], names=["__id", "__th", "key", "n", "parity"])

    info = written(rows.mapInArrow(name, "`__id` bigint, `__th` bigint, key bigint, n bigint, parity binary"))
    groups = written(_candidates(rows.select("text"), shards))
    wanted = groups.select("key").distinct()
    known = info.where("n > 0").groupBy("key").agg(F.min(F.struct("__id", "__th")).alias("at"), F.max("n").alias("n"), F.max("parity").alias("parity"))
    known = written(known.join(wanted, "key", "left_semi").select("key", "at.*", "n", "parity"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unpackable(batches):
            h, at = sets(pa.array(unpacked(part.column("__z")), pa.large_binary()))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([_packed(h[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["key", "elements"])

    def elements_of(wanted: DataFrame) -> DataFrame:
        """key, elements of the sets wanted, read from a document of each."""
        chosen = written(known.join(wanted, "key", "left_semi").select("key", "__id", "__th"))
        return written(compressed(docs, [], Sieve(chosen)).join(chosen, ["__id", "__th"]).dropDuplicates(["__id", "__th"]).mapInArrow(read, "key bigint, elements binary"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()

    roots = known.select("key", F.col("key").alias("root"))
    parts = 1 + groups.count() // SHARD_ROWS
    stars = written(_stars(groups, known, parts))
    pairs = stars.where("a is not null").select("a", "b")
    if stars.isEmpty():
        return info.drop("parity"), roots
    elements = elements_of(ends(pairs))
    roots = _grown(roots, pairs, elements)
    # groups whose members may have further links, and are still of several components
    named = roots.join(known.select("key", "n"), "key")
    members = groups.select("grp", "key").join(stars.where("grp is not null").select("grp"), "grp", "left_semi").join(named, "key")
    several = members.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("total")).where("low <> high").drop("high")
    found = written(_open(members.join(several, "grp"), known, parts))
    if found.isEmpty():
        return info.drop("parity"), roots
    missing = written(found.select("key").distinct().join(elements.select("key"), "key", "left_anti"))
    if not missing.isEmpty():
        elements = elements.unionAll(elements_of(missing))
    edges = written(_rest(found, known, elements))
    return info.drop("parity"), roots if edges.isEmpty() else _merged(roots, edges)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the lowest id that links reach.

    Texts without words, and null and empty ones, have no shingles and are linked with nothing. Very long texts are
    compared whole. Repeated rows are one document, each row with its result. Rows of one id with
    different texts are different documents of that id. A null id is lower than all and stays null. Other
    columns are not looked at; an empty table gives none.
    """
    info, roots = classes(docs)
    lowest = info.where("n > 0").groupBy("key").agg(F.min("__id").alias("low"))
    lowest = lowest.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    low = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    named = lowest.join(low, "root").select("key", "component_id")
    plain = lambda c: F.when(c != NO_ID, c)
    out = info.join(named.withColumn("some", F.lit(True)), (info["key"] == named["key"]) & (info["n"] > 0), "left")
    return out.select(plain(F.col("__id")).alias("doc_id"), F.col("n").alias("n_shingles"), plain(F.when(F.col("some"), F.col("component_id")).otherwise(F.col("__id"))).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows, with their columns whatever their names, of one document of each group of linked ones: that of the lowest id.

    Documents without words (null and empty texts too) all stay. Of rows that repeat an id and text, one
    stays; a null id is an id, the lowest. Very long texts are compared whole. An empty table gives none.
    """
    plain = neutral(docs)
    info, roots = classes(plain)
    best = info.where("n > 0").groupBy("key").agg(F.min(F.struct("__id", "__th")).alias("at"))
    best = best.join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("at").alias("at")).select("at.*")
    bare = info.where("n = 0").select("__id", "__th").distinct()
    stay = best.unionByName(bare)
    kept = plain.select("*", *identity(plain)).join(stay, ["__id", "__th"], "left_semi")
    again = written(info.where("n > 0").groupBy("__id", "__th").agg(F.count("*").alias("rows")).where("rows > 1").select("__id", "__th"))
    if not again.isEmpty():
        kept = kept.join(again, ["__id", "__th"], "left_anti").unionAll(kept.join(again, ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"]))
    return kept.drop("__id", "__th").toDF(*docs.columns)
