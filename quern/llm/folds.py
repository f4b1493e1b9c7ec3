"""Labelled samples for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.spread import written

SAMPLE_BYTES = 32 << 20  # of text that a fit reads, and the end of the row that reaches it


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, ones: float = 0.5, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most rows labelled rows outside the held fold, a share of ones at most with label 1: doc_id, text, label, weight.

    The weights make up for the shares: those of a label sum to its number of labelled rows, over all of them.

    The rows are those with the lowest hash of the id, whole texts, as long as the texts before them have fewer
    than most_bytes together; of several texts of an id the lowest counts. What is broadcast are these
    ids with their labels: rows * 16 bytes.
    """
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels[label].cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held)).distinct()
    order = F.xxhash64("doc_id", F.lit(label))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    most = {1: int(rows * ones), 0: rows - int(rows * ones)}
    sides = [known.where(F.col("label") == side).orderBy(order, "doc_id").limit(most[side]).withColumn("weight", F.lit(max(1.0, counts.get(side, 0) / most[side]))) for side in (0, 1)]
    picked = sides[0].unionAll(sides[1])
    found = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]).join(F.broadcast(picked), "doc_id")
    found = written(found.groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text")))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    before = F.sum("size").over(Window.orderBy(order, "doc_id", "label").rowsBetween(Window.unboundedPreceding, -1))  # of at most rows rows
    kept = found.select("doc_id", "label", size.alias("size")).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most_bytes)
    return found.join(F.broadcast(kept.select("doc_id", "label")), ["doc_id", "label"]).select("doc_id", "text", "label", "weight")


def held_out(doc_id: Column, folds: int, held: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == held, F.lit(False))


def logistic(x, y, weight, steps: int = 200):
    """Weights (last: intercept) of a logistic fit by Newton's method with a small ridge."""
    import numpy as np

    x = np.column_stack((x, np.ones(len(y))))
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1e-2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w
