"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space: 1 / ``SCALE`` of it, for
texts of few shingles the double as often as it takes to expect ``EXPECTED`` hashes, up to the whole
space. The fraction, and with it the sketch's bound, depends on the number of shingles alone and not on
their hashes, so what is kept is a fair sample at every length. Two sketches are compared below
the smaller bound, where both are complete, which estimates Jaccard likeness and either containment
without bias however unequal the texts; sketches merge by union below the smaller bound. Hashes are kept to
their upper 40 bits and written as hex, in ascending order.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.anchors import NO_ID
from quern.llm.arrow import shingle_hashes, texts, word_hashes, words
from quern.llm.repeats import compressed, identity, unpackable, unpacked
from quern.llm.spread import partitions

SHINGLE = 5
SCALE = 4  # one hash in so many is kept
EXPECTED = 64  # hashes of a sketch, unless the text has fewer shingles
BITS = 40


class Sketch:
    """Kept hashes (sorted) and the bound below which they are complete."""

    def __init__(self, kept: np.ndarray, bound: int) -> None:
        self.kept, self.bound = kept, bound

    @classmethod
    def of(cls, hashes: np.ndarray) -> Sketch:
        found = np.unique(hashes >> np.uint64(64 - BITS))
        part = SCALE
        while part > 1 and len(found) < part * EXPECTED:
            part //= 2
        bound = (1 << BITS) // part
        return cls(found[: np.searchsorted(found, bound)] if part > 1 else found, bound)

    def text(self) -> str:
        return f"{self.bound:x}:" + ",".join(map("{:x}".format, self.kept.tolist()))

    @classmethod
    def parse(cls, text: str) -> Sketch:
        bound, _, kept = text.partition(":")
        return cls(np.array([int(x, 16) for x in kept.split(",") if x], np.uint64), int(bound, 16))

    def merged(self, other: Sketch) -> Sketch:
        """The sketch of both texts' shingles together."""
        bound = min(self.bound, other.bound)
        both = np.union1d(self.kept, other.kept)
        return Sketch(both[both < np.uint64(bound)] if bound < 1 << BITS else both, bound)

    def _shared(self, other: Sketch) -> tuple[int, int, int]:
        bound = min(self.bound, other.bound)
        a, b = (x.kept[: np.searchsorted(x.kept, bound)] for x in (self, other))
        return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard likeness; two sketches without shingles are alike."""
        both, a, b = self._shared(other)
        return both / (a + b - both) if a + b else 1.0

    def containment(self, other: Sketch) -> float:
        """Estimated share of this sketch's shingles that the other has too."""
        both, a, _ = self._shared(other)
        return both / a if a else 1.0


def sketches(column: pa.Array) -> list[Sketch]:
    t = texts(column)
    w = words(t)
    h, at = shingle_hashes(word_hashes(t, w), w.first, SHINGLE)
    return [Sketch.of(h[a:b]) for a, b in zip(at, at[1:], strict=False)]


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def in_order(docs: DataFrame) -> DataFrame:
    """run, echo, doc_id, __z (compressed text): documents by id in consecutive runs, each a partition.

    Each run ends with a copy (echo) of the document after it, the last with one of the first. Runs are
    ranges of ids between quantiles, so what the driver holds is a row for each run; text is shuffled
    once. Equal ids are ordered by a hash of the text, and where an id fills several quantiles, its runs
    are ranges of that hash; rows of equal id and text stay together. A null id comes first.
    """
    n = 2 * partitions(docs.sparkSession)
    name, th = identity(docs)
    ids = docs.select(name, th)
    cuts = sorted(int(c) for c in ids.stat.approxQuantile("__id", [i / n for i in range(1, n)], 0.2 / n)) if n > 1 else []
    times = Counter(cuts)
    bounds = [(c, -(1 << 63) + (k << 64) // times[c]) for c in sorted(times) for k in range(times[c])]
    bound_ids, bound_hashes = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    def run_of(batch: pa.RecordBatch) -> np.ndarray:
        """Bounds up to each row."""
        own, th = batch.column("__id").to_numpy(), batch.column("__th").to_numpy()
        run, high = (np.searchsorted(bound_ids, own, side) for side in ("left", "right"))
        begins = run.copy()
        for low in np.unique(begins[high > begins]):
            here = begins == low
            here &= high > begins
            run[here] += np.searchsorted(bound_hashes[low : high[here][0]], th[here], "right")
        return run

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(run_of(batch)), batch.column("__id"), batch.column("__th")], names=["run", "__id", "__th"])

    heads = ids.mapInArrow(runs_of, "run bigint, `__id` bigint, `__th` bigint").groupBy("run").agg(F.min(F.struct("__id", "__th")).alias("head")).orderBy("run").collect()
    # runs that have rows are numbered; the one before each head's takes the echo, the first head closes the last
    target = {(h["head"]["__id"], h["head"]["__th"]): (i - 1) % len(heads) for i, h in enumerate(heads)}
    number = np.zeros(len(bounds) + 1, np.int64)
    number[[h["run"] for h in heads]] = np.arange(len(heads))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("__id").to_pylist(), batch.column("__th").to_pylist(), strict=True))
            again = [i for i, k in enumerate(keys) if k in target]
            own = number[run_of(batch)]
            pick = np.concatenate((np.arange(len(keys)), np.array(again, np.int64)))
            run = np.concatenate((own, np.array([target[keys[i]] for i in again], np.int64)))
            rows = batch.take(pa.array(pick))
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(np.arange(len(pick)) >= len(keys)), *(rows.column(c) for c in ("__id", "__th", "__z"))], names=["run", "echo", "__id", "__th", "__z"])

    rows = compressed(docs, []).mapInArrow(deal, "run bigint, echo boolean, `__id` bigint, `__th` bigint, `__z` binary")
    rows = rows.repartitionById(max(1, len(heads)), F.col("run").cast("int")).sortWithinPartitions("run", "echo", "__id", "__th")
    return rows.select("run", "echo", F.when(F.col("__id") != NO_ID, F.col("__id")).alias("doc_id"), "__z")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, and the likeness to the edited and the next text.

    Null texts count as empty. The next document is the next row by doc_id and a hash of the text, null ids
    first, so rows of equal id follow each other; a table of one row has itself as next. Texts without words
    have an empty sketch, and two such are alike (1.0). A very long text is held with the next one, whole. Other
    columns are not looked at; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int | None, str] | None = None  # run, id and text of the row before, whose next isn't known yet
        closed = None
        for part in unpackable(batches):
            pairs = []
            columns = (part.column(c).to_pylist() for c in ("run", "echo", "doc_id"))
            for at, echo, name, raw in zip(*columns, unpacked(part.column("__z")), strict=True):
                if echo and closed == at:
                    continue  # a further row with the head's id and text
                text = raw.decode()
                if held is not None and held[0] == at:
                    pairs.append((held[1], held[2], text))
                held = None if echo else (at, name, text)
                closed = at if echo else closed
            if pairs:
                yield described(pairs)

    return in_order(docs).mapInArrow(run, SCHEMA)


def described(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    changed = [edited(text, following) for _, text, following in pairs]
    own = sketches(pa.array([text for _, text, _ in pairs], pa.large_string()))
    new = sketches(pa.array(changed, pa.large_string()))
    follows = [i + 1 < len(pairs) and pairs[i][2] is pairs[i + 1][1] for i in range(len(pairs))]
    extra = iter(sketches(pa.array([p[2] for p, f in zip(pairs, follows, strict=True) if not f], pa.large_string())))
    after = [own[i + 1] if f else next(extra) for i, f in enumerate(follows)]
    columns = [
        pa.array([name for name, _, _ in pairs], pa.int64()),
        pa.array([len(text) for _, text, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
        pa.array([x.text() for x in own]),
        pa.array([x.text() for x in new]),
        pa.array([a.likeness(b) for a, b in zip(own, new, strict=True)]),
        pa.array([a.likeness(b) for a, b in zip(own, after, strict=True)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])
