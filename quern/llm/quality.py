"""Quality scores by Naive Bayes support vectors.

A text's indicators of hashed n-grams (words, pairs of words, runs of four bytes; pairs and triples of
words' shapes, and which of four words repeat the one before) are scaled by
the log-count ratio of the two classes and to unit length; a linear hinge-loss model over them is
fit by dual coordinate descent, one document at a time; a logistic fit on a part of the sample that
the model hasn't seen turns margins into scores.

The model is fit in one task on a bounded sample (``SAMPLE`` labelled rows, of which only
bucket numbers travel, at most ``BUCKETS`` a row); what comes to the driver and is broadcast is
one float for each bucket, 4 * BUCKETS bytes whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.arrow import ODD, Texts, Words, mix, pieces, texts, word_hashes, words
from quern.llm.folds import held_out, labelled_sample, logistic

SAMPLE = 4000
BUCKETS = 1 << 18
SMOOTHING = 1.0
PENALTY = 1.0
EPOCHS = 30


class Indicators:
    """The distinct buckets of a document's n-grams; the scratch array is used again and again."""

    def __init__(self) -> None:
        self.last = np.zeros(BUCKETS, np.int64)

    def of(self, t: Texts) -> Iterator[np.ndarray]:
        w: Words = words(t)
        one = word_hashes(t, w)
        pair = mix(one[:-1] * ODD + one[1:]) if len(one) > 1 else one[:0]
        data = t.data.astype(np.uint64)
        four = mix((data[:-3] << np.uint64(24) | data[1:-2] << np.uint64(16) | data[2:-1] << np.uint64(8) | data[3:]) + np.uint64(7)) if len(data) > 3 else data[:0]
        shape = shapes(t, w)
        same = np.zeros(len(one), np.uint64)
        same[1:] = one[1:] == one[:-1]
        if len(one) > 2:
            two = mix(shape[:-2] * np.uint64(100_003) + shape[1:-1] + np.uint64(13))
            three = mix(two + shape[2:] * ODD)
        else:
            two = three = one[:0]
        again = mix(same[:-3] + np.uint64(2) * same[1:-2] + np.uint64(4) * same[2:-1] + np.uint64(8) * same[3:] + np.uint64(17)) if len(one) > 3 else one[:0]
        low = np.uint64(BUCKETS - 1)
        one, pair, four, two, three, again = ((x & low).astype(np.int64) for x in (one, pair, four, two, three, again))
        for a, b, i, j in zip(t.at, t.at[1:], w.first, w.first[1:], strict=False):
            inner = max(i, j - 2)
            found = np.concatenate((one[i:j], pair[i : max(i, j - 1)], four[a : max(a, b - 3)], two[i:inner], three[i:inner], again[i : max(i, j - 3)]))
            order = np.arange(len(found))
            self.last[found] = order
            yield found[self.last[found] == order]


def shapes(t: Texts, w: Words) -> np.ndarray:
    """A small number for each word: what its first and last bytes are, whether it is in capitals, how long it is."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    kind = np.zeros(256, np.uint64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 4
    upper = np.concatenate(([0], np.cumsum((t.data >= 65) & (t.data < 91))))
    lower = np.concatenate(([0], np.cumsum((t.data >= 97) & (t.data < 123))))
    capitals = ((upper[w.end] - upper[w.start]) > 1) & (lower[w.end] == lower[w.start])
    last = np.where(kind[t.data[w.end - 1]] > 0, kind[t.data[w.end - 1]], t.data[w.end - 1].astype(np.uint64) + np.uint64(8))
    size = np.minimum(np.log2(w.end - w.start).astype(np.uint64), np.uint64(6))
    return ((kind[t.data[w.start]] * np.uint64(300) + last) * np.uint64(2) + capitals.astype(np.uint64)) * np.uint64(8) + size


def fit(rows: list[np.ndarray], labels: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """One weight for each bucket, then a scale and an intercept for the score."""
    model = np.zeros(BUCKETS + 2)
    if len(set(labels.tolist())) < 2:
        model[-1] = np.log(((worth * labels).sum() + 1) / ((worth * (1 - labels)).sum() + 1))
        return model
    # three quarters of each class for the model, the rest for its scale; a class of one row serves both
    rng = np.random.default_rng(5)
    learnt, rest = [], []
    for side in (0, 1):
        own = rng.permutation(np.flatnonzero(labels == side))
        cut = max(1, len(own) * 3 // 4)
        learnt.append(own[:cut])
        rest.append(own[cut:] if len(own) > 1 else own)
    learnt, rest = np.concatenate(learnt), np.concatenate(rest)
    ratio = np.zeros(BUCKETS)
    for side, sign in ((1, 1), (0, -1)):
        count = np.full(BUCKETS, SMOOTHING)
        for i in learnt:
            if labels[i] == side:
                count[rows[i]] += 1
        ratio += sign * np.log(count / count.sum())
    scaled = [(v / (np.linalg.norm(v) or 1)).astype(np.float32) for v in (ratio[x] for x in rows)]
    sign = np.where(labels == 1, 1.0, -1.0)
    bound = {s: PENALTY * len(learnt) / (2 * max(1, (sign[learnt] == s).sum())) for s in (1.0, -1.0)}
    weights, bias, dual = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(6)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(learnt):
            x, v, y = rows[i], scaled[i], sign[i]
            gradient = y * (weights[x] @ v + bias) - 1
            new = min(max(dual[i] - gradient / (v @ v + 1), 0.0), bound[y])
            if new != dual[i]:
                weights[x] += (new - dual[i]) * y * v
                bias += (new - dual[i]) * y
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-4:
            break
    margin = np.array([weights[rows[i]] @ scaled[i] + bias for i in rest])
    slope, level = logistic(margin[:, None], labels[rest], worth[rest])
    model[:BUCKETS] = weights
    # margins need the ratios' lengths as well, so both tables are kept
    return np.concatenate((model[:BUCKETS], ratio, [bias, slope, level]))


def train(docs: DataFrame, labels: DataFrame, folds: int, held: int, sample: int = SAMPLE) -> np.ndarray:
    """Fits on at most sample labelled rows; only labels, texts and the fold take part."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for piece in pieces(batches, "text"):
            found = [x.astype("<i4").tobytes() for x in indicators.of(texts(piece.column("text")))]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), piece.column("weight"), pa.array(found, pa.binary())], names=["doc_id", "label", "weight", "buckets"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        rows = [np.frombuffer(x, "<i4") for x in table.column("buckets").to_pylist()]
        return pa.table({"model": [fit(rows, np.array(table.column("label").to_pylist(), np.int64), np.array(table.column("weight").to_pylist())).astype("<f4").tobytes()]})

    rows = labelled_sample(docs, labels, "quality", folds, held, sample).mapInArrow(features, "doc_id bigint, label int, weight double, buckets binary")
    made = rows.groupBy().applyInArrow(learn, "model binary").collect()
    return np.frombuffer(made[0]["model"], "<f4") if made else np.zeros(BUCKETS + 2, np.float32)


def scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= threshold) of each row's whole text.

    Null and empty texts have no n-grams and get the score of a zero margin. Very long texts are scored whole.
    A score equal to the threshold is predicted 1. A null id counts as not
    held out. Repeated rows are scored each on its own; columns other than doc_id and text are never
    inputs; an empty table gives none; without labels of both kinds the score is the labels' smoothed
    share.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = model.value.astype(np.float64)
        indicators = Indicators()
        for piece in pieces(batches, "text"):
            if len(value) == BUCKETS + 2:
                score = np.full(piece.num_rows, 1 / (1 + np.exp(-value[-1])))
            else:
                weight = value[:BUCKETS] * value[BUCKETS : 2 * BUCKETS]
                square = value[BUCKETS : 2 * BUCKETS] ** 2
                bias, slope, level = value[-3:]
                margin = np.array([weight[x].sum() / (np.sqrt(square[x].sum()) or 1) for x in indicators.of(texts(piece.column("text")))])
                score = 1 / (1 + np.exp(-np.clip(slope * (margin + bias) + level, -30, 30)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), held_out(docs["doc_id"], folds, held).alias("held_out"), docs["text"])
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
