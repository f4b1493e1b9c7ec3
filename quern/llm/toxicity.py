"""Toxic spans by a linear-chain conditional random field over tokens.

Tokens are runs of letters and digits. Each has features by hash: the lower-cased token, its
first bytes, and its neighbours. The field has two states (clean, toxic) with learnt transitions.
Labelled tokens for the fit come from the document labels: in a toxic document, the tokens with a
feature that so many toxic documents hold (or hold again: once may be chance where words are inflected
freely), and so much more often than clean ones, that chance is ruled out, are toxic, all others clean. Forward-backward gives each token's marginal. As the chain has two states, what a
run of tokens does to the forward (or backward) vector is a 2x2 matrix: runs of equal length are
multiplied up side by side and composed by a prefix scan, so very long documents cost no more
steps than short ones.

A document's score is a logistic function of its expected number of toxic tokens, their share and its
highest marginal. The fit runs in one task over a bounded sample (``SAMPLE`` labelled rows, ``folds.SAMPLE_BYTES``
of text); what comes to the driver and is broadcast has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.arrow import LOWER, Texts, Words, byte_sums, pieces, range_hash, texts
from quern.llm.folds import held_out, labelled_sample, logistic
from quern.llm.spread import neutral

SAMPLE = 4000
ONES = 0.25  # of the sample, at most
CHANCE = 1e-5  # with which a feature of a toxic token may be in toxic documents alone
RATIO = 25  # how much more often it is in toxic documents
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6)
KINDS = 1 + len(PREFIXES) + 2
RUN = 128
EPOCHS = 6
EVIDENCE = 4  # weights of a document's score, with the intercept
PRIOR_TOKENS = 20  # which the share of toxic tokens counts besides a document's own

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(t: Texts) -> Words:
    solid = WORD_BYTE[t.data]
    n = len(solid)
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    begin[t.at[t.at < n]] = solid[t.at[t.at < n]]
    end[:-1] &= ~solid[1:]
    stops = t.at[t.at > 0] - 1
    end[stops] = solid[stops]
    start = np.flatnonzero(begin)
    return Words(start, np.flatnonzero(end) + 1, np.searchsorted(start, t.at))


def features(t: Texts, w: Words) -> np.ndarray:
    """Bucket numbers, one row for each kind of feature."""
    out = np.empty((KINDS, len(w.start)), np.int32)
    if not len(w.start):
        return out
    sums = byte_sums(LOWER[t.data])

    def put(kind: int, h: np.ndarray) -> None:
        out[kind] = ((h >> np.uint64(kind)) + np.uint64(kind * 7919) & np.uint64(BUCKETS - 1)).astype(np.int32)

    whole = range_hash(sums, w.start, w.end)
    put(0, whole)
    for k, n in enumerate(PREFIXES, 1):
        put(k, range_hash(sums, w.start, np.minimum(w.start + n, w.end)))
    before, after = np.roll(whole, 1), np.roll(whole, -1)
    starts, ends = w.first[:-1][np.diff(w.first) > 0], w.first[1:][np.diff(w.first) > 0] - 1
    before[starts], after[ends] = 0, 0
    put(KINDS - 2, before)
    put(KINDS - 1, after)
    return out


def _compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2x2 matrices laid out as four rows, scaled to sum 1."""
    out = np.stack((a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]))
    return out / out.sum(0)


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and the expected counts of the four transitions.

    emission: log-odds of toxic; first: whether a chain begins; trans: 2x2 log-potentials; start: the
    log-odds of toxic at a chain's begin.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros(4)
    rows = -(-n // RUN)
    hot = 1 / (1 + np.exp(-np.clip(emission, -30, 30)))
    t = np.exp(trans - trans.max())
    begin = 1 / (1 + np.exp(-start))
    m = np.empty((4, rows * RUN))
    m[:, n:] = np.array([0.5, 0.0, 0.0, 0.5])[:, None]  # what follows the end changes nothing
    m[0, :n], m[1, :n], m[2, :n], m[3, :n] = t[0, 0] * (1 - hot), t[0, 1] * hot, t[1, 0] * (1 - hot), t[1, 1] * hot
    where = np.flatnonzero(first)
    m[0, where] = m[2, where] = (1 - begin) * (1 - hot[where])
    m[1, where] = m[3, where] = begin * hot[where]
    m /= m.sum(0)
    grid = np.ascontiguousarray(m.reshape(4, rows, RUN).transpose(2, 0, 1))
    whole = grid[0]
    for i in range(1, RUN):
        whole = _compose(whole, grid[i])
    upto, reach = whole.copy(), 1
    while reach < rows:
        upto[:, reach:] = _compose(upto[:, :-reach], upto[:, reach:])
        reach *= 2
    onward, reach = whole.copy(), 1
    while reach < rows:
        onward[:, :-reach] = _compose(onward[:, :-reach], onward[:, reach:])
        reach *= 2
    half = np.array([0.5, 0.5])[:, None]
    a = np.concatenate((half, np.stack((upto[0] + upto[2], upto[1] + upto[3]))[:, :-1]), 1)
    a /= a.sum(0)
    b = np.concatenate((np.stack((onward[0] + onward[1], onward[2] + onward[3]))[:, 1:], half), 1)
    b /= b.sum(0)
    alpha, beta = np.empty((RUN, 2, rows)), np.empty((RUN, 2, rows))
    for i in range(RUN):
        g = grid[i]
        a = np.stack((a[0] * g[0] + a[1] * g[2], a[0] * g[1] + a[1] * g[3]))
        a /= a.sum(0)
        alpha[i] = a
    for i in range(RUN - 1, -1, -1):
        beta[i] = b
        g = grid[i]
        b = np.stack((g[0] * b[0] + g[1] * b[1], g[2] * b[0] + g[3] * b[1]))
        b /= b.sum(0)
    alpha, beta = (x.transpose(1, 2, 0).reshape(2, -1)[:, :n] for x in (alpha, beta))
    both = alpha * beta
    p = both[1] / both.sum(0)
    inner = np.flatnonzero(~first)
    inner = inner[inner > 0]
    pairs = np.stack([alpha[i, inner - 1] * m[2 * i + j, inner] * beta[j, inner] for i in (0, 1) for j in (0, 1)])
    return p, (pairs / pairs.sum(0)).sum(1)


class Field:
    """The field's weights, as one array of floats."""

    def __init__(self, values: np.ndarray | None = None) -> None:
        self.values = np.zeros(BUCKETS + 5 + EVIDENCE) if values is None else values.astype(np.float64)

    def tag(self, t: Texts) -> tuple[Words, np.ndarray]:
        w = tokens(t)
        return w, self.posterior(features(t, w), w)[0]

    def posterior(self, f: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
        weights = self.values[:BUCKETS]
        emission = np.zeros(f.shape[1])
        for row in f:
            emission += weights[row]
        first = np.zeros(f.shape[1], bool)
        first[w.first[:-1][np.diff(w.first) > 0]] = True
        return marginals(emission, first, self.values[BUCKETS : BUCKETS + 4].reshape(2, 2), float(self.values[BUCKETS + 4]))

    @staticmethod
    def evidence(p: np.ndarray, w: Words) -> np.ndarray:
        """Each document's expected number of toxic tokens, their share and the highest marginal, as logarithms."""
        total = np.concatenate(([0.0], np.cumsum(p)))
        spans = np.diff(w.first)
        high = np.zeros(len(spans))
        full = np.flatnonzero(spans)
        if len(full):
            high[full] = np.maximum.reduceat(p, w.first[:-1][full])
        expected = np.maximum(total[w.first[1:]] - total[w.first[:-1]], 0) + 1e-3
        high = np.clip(high, 1e-6, 1 - 1e-6)
        return np.column_stack((np.log(expected), np.log(expected / (spans + PRIOR_TOKENS)), np.log(high / (1 - high))))

    def score(self, p: np.ndarray, w: Words) -> np.ndarray:
        z = np.column_stack((self.evidence(p, w), np.ones(len(w.first) - 1))) @ self.values[-EVIDENCE:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, t: Texts, labels: np.ndarray, worth: np.ndarray) -> Field:
        """Labelled tokens from labelled documents, then adaptive gradient steps on the log-likelihood."""
        self.values[-1] = np.log(((worth * labels).sum() + 0.5) / ((worth * (1 - labels)).sum() + 0.5))
        if len(set(labels.tolist())) < 2:
            return self
        w, f = _in_parts(t)
        owner = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(w.first))
        gold = np.zeros(f.shape[1], bool)
        for row in f[: KINDS - 2]:
            # each bucket once for each document, and once for each that has it again
            order = np.argsort(row, kind="stable")
            once = np.ones(len(order), bool)
            once[1:] = (np.diff(row[order]) != 0) | (np.diff(owner[order]) != 0)
            again = np.zeros(len(order), bool)
            again[1:] = once[:-1] & ~once[1:]
            for chosen in (order[once], order[again]):
                within = [np.bincount(row[chosen[labels[owner[chosen]] == side]], minlength=BUCKETS) for side in (0, 1)]
                rate = [(within[side] + 0.5) / ((labels == side).sum() + 1) for side in (0, 1)]
                mark = (within[1] >= np.log(CHANCE) / np.log(labels.mean())) & (rate[1] / rate[0] >= RATIO)
                gold |= mark[row] & (labels[owner] == 1)
        square = np.full(BUCKETS + 5, 1e-8)
        rng = np.random.default_rng(8)
        for _ in range(EPOCHS):
            for some in np.array_split(rng.permutation(len(labels)), max(1, min(32, len(labels) // 16))):
                at, own = _some(w, some)
                fs, y = f[:, at], gold[at]
                p, pairs = self.posterior(fs, own)
                step = np.zeros(BUCKETS + 5)
                for row in fs:
                    step[:BUCKETS] += np.bincount(row, y - p, BUCKETS)
                inner = np.ones(len(at), bool)
                begins = own.first[:-1][np.diff(own.first) > 0]
                inner[begins] = False
                to = np.flatnonzero(inner)
                seen = np.bincount(2 * y[to - 1] + y[to], minlength=4)
                step[BUCKETS : BUCKETS + 4] = seen - pairs
                step[BUCKETS + 4] = (y[begins] - p[begins]).sum()
                step[:BUCKETS] -= 0.01 * self.values[:BUCKETS]
                square += step**2
                self.values[: BUCKETS + 5] += 0.4 * step / np.sqrt(square)
        found = []
        for some in np.array_split(np.arange(len(labels)), max(1, len(labels) // 128)):
            at, own = _some(w, some)
            found.append(self.evidence(self.posterior(f[:, at], own)[0], own))
        self.values[-EVIDENCE:] = logistic(np.concatenate(found), labels, worth)
        return self


def _in_parts(t: Texts) -> tuple[Words, np.ndarray]:
    """Tokens and features of many texts, about a MB at a time."""
    starts, ends, counts, rows, begin = [], [], [], [], 0
    while begin < len(t.at) - 1:
        end = max(begin + 1, int(np.searchsorted(t.at, t.at[begin] + (1 << 20), "right")) - 1)
        part = Texts(t.data[t.at[begin] : t.at[end]], t.at[begin : end + 1] - t.at[begin])
        w = tokens(part)
        starts.append(w.start + t.at[begin])
        ends.append(w.end + t.at[begin])
        counts.append(np.diff(w.first))
        rows.append(features(part, w))
        begin = end
    first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    return Words(np.concatenate(starts), np.concatenate(ends), first), np.concatenate(rows, 1)


def _some(w: Words, some: np.ndarray) -> tuple[np.ndarray, Words]:
    """The tokens of some documents, and these documents as if they were all."""
    n = np.diff(w.first)[some]
    first = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(w.first[some] - first[:-1], n) + np.arange(first[-1])
    return at, Words(w.start, w.end, first)


def train(docs: DataFrame, labels: DataFrame, folds: int, held: int, sample: int = SAMPLE) -> Field:
    """Fits on at most sample labelled rows."""

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        column = table.column("text").combine_chunks()
        t = texts(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        field = Field().fit(t, np.array(table.column("label").to_pylist(), np.int64), np.array(table.column("weight").to_pylist()))
        return pa.table({"model": [field.values.astype("<f4").tobytes()]})

    made = labelled_sample(docs, labels, "toxic", folds, held, sample, ONES).groupBy().applyInArrow(learn, "model binary").collect()
    return Field(np.frombuffer(made[0]["model"], "<f4")) if made else Field()


def tagged(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows' columns, with score (0 to 1), predicted (score >= threshold) and spans.

    spans are the offending offsets: code points from start up to end of each run of tokens whose
    marginals are 0.5 or more. Null and empty texts have no tokens and get the lowest evidence.
    A very long text is scored whole, in chunks of ``RUN`` tokens. A score equal to the threshold is predicted
    toxic. Repeated rows are scored each on its own; only texts are inputs; columns of the same names as the
    new ones are replaced; an empty table gives none; without labels of both kinds, the score is the
    labels' smoothed share.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held, sample).values.astype("<f4"))
    rows = neutral(docs)
    own = {c: n for c, n in zip(rows.columns, docs.columns, strict=True) if n not in ("score", "predicted", "spans")}
    kept = list(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(model.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for piece in pieces(batches, "text", 1 << 20):
            t = texts(piece.column("text"))
            w, p = field.tag(t)
            score = field.score(p, w)
            found: list[list] = [[] for _ in range(piece.num_rows)]
            hit = np.flatnonzero(p >= 0.5)
            if len(hit):
                owner = np.searchsorted(w.first, hit, "right") - 1
                points = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80)))
                a, b = points[w.start[hit]] - points[t.at[owner]], points[w.end[hit]] - points[t.at[owner]]
                joined = np.concatenate(([False], (np.diff(hit) == 1) & (np.diff(owner) == 0)))
                for i, own in enumerate(owner.tolist()):
                    if joined[i]:
                        found[own][-1]["end"] = int(b[i])
                    else:
                        found[own].append({"start": int(a[i]), "end": int(b[i])})
            new = [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *new], names=[*kept, "score", "predicted", "spans"])

    rows = rows.select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, score double, predicted int, spans array<struct<start: bigint, end: bigint>>").toDF(*own.values(), "score", "predicted", "spans")


def scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of each row; a null id counts as not held out."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), held_out(docs["doc_id"], folds, held).alias("held_out"), docs["text"])
    return tagged(rows, labels, folds, held, threshold, sample).drop("text")


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows that are not predicted toxic, with their own columns, whatever their names.

    Null and empty texts have no tokens and get the lowest evidence, so they stay unless nearly all
    labels are toxic. Repeated rows stay or go together; an empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held, sample).values.astype("<f4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(model.value)
        for piece in pieces(batches, "text", 1 << 20):
            w, p = field.tag(texts(piece.column("text")))
            yield piece.filter(pa.array(field.score(p, w) < threshold))

    plain = neutral(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
