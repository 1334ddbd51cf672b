"""What the learned operators share: bounded labelled samples and sigmoid calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, local_rows, materialize

#: Bytes of the texts that are learned from, for each class.
CLASS_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int, held_out: int, class_bytes: int = CLASS_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most per_class rows of each class 0 and 1, and the classes' full counts.

    Rows whose id has the held-out remainder, null ids and labels other than 0 and 1 are never used.
    An id with several labels counts once, with the larger; an id with several texts with the least.
    Ids are taken in the order of a hash, so the sample is the same at each run, and at most
    2 * per_class ids are broadcast. Texts are whole: one that doesn't fit in what the texts before it
    leave of its class's class_bytes isn't learned from. The sample is written once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (id_remainder(F.col("doc_id"), modulus) != held_out))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {row.label: row.n for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [row for k in (0, 1) for row in known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    ids = local_rows(docs.sparkSession, chosen, "doc_id long, label int").withColumnRenamed("doc_id", "chosen_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("chosen_id")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = materialize(found.withColumns({"place": F.xxhash64("doc_id"), "bytes": F.octet_length("text")}), "sample")
    left, too_long = {0: class_bytes, 1: class_bytes}, []
    for row in found.select("label", "place", "doc_id", "bytes").orderBy("place", "doc_id").collect():  # at most 2 * per_class rows
        if row.bytes > left[row.label]:
            too_long.append(row.doc_id)
        else:
            left[row.label] -= row.bytes
    return found.where(~F.col("doc_id").isin(too_long)).select("doc_id", "text", "label"), counts


def held_out_column(col: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(id_remainder(col, modulus) == remainder, F.lit(False))


def fit_sigmoid(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b) by weighted Newton steps on smoothed targets; a constant where a class is missing."""
    n1, n0 = weight[label == 1].sum(), weight[label == 0].sum()
    b0 = float(np.log((n1 + 1) / (n0 + 1)))
    if not n1 or not n0:
        return 0.0, b0
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta = np.array([0.0, b0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    loss = lambda t: float((weight * (np.logaddexp(0, x @ t) - target * (x @ t))).sum() + 1e-6 * t[0] ** 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        gradient = x.T @ (weight * (p - target)) + [2e-6 * theta[0], 0]
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def class_weights(label: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give a sample's classes the shares that they have among all labelled rows."""
    weight = np.ones(label.size)
    for k in (0, 1):
        if (label == k).any():
            weight[label == k] = counts.get(k, 0) / (label == k).sum()
    return weight * label.size / weight.sum() if label.size else weight
