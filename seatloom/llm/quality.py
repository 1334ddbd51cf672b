"""Operator 5, quality classifier: Naive Bayes support vectors.

Indicators of token n-grams are scaled by class log-count ratios; a linear hinge-loss model over them
is fitted by dual coordinate descent; its margin becomes a probability by a sigmoid fitted on a part
of the sample that the model hasn't seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, give_back, keep, map_arrow, slices
from .learning import class_weights, fit_sigmoid, held_out_column, labelled_sample, sigmoid

#: The bound of the sample that is learned from: rows of each class.
PER_CLASS = 2000
HELD_OUT = (5, 0)
THRESHOLD = 0.3
#: An n-gram is a feature if so many documents of the sample have it.
LEAST_DOCUMENTS = 3
#: Tokens whose hashes a worker keeps.
KNOWN_TOKENS = 100_000

_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _token_hash(token: str, known: dict[str, int]) -> int:
    found = zlib.crc32(token.encode("utf-8", "replace"))
    if len(known) < KNOWN_TOKENS:
        known[token] = found
    return found


def features(text: str | None) -> np.ndarray:
    """Sorted 64-bit ids of the different tokens and token pairs. Tokens are runs of letters, digits or other marks, case kept."""
    tokens = _TOKENS(text or "")
    known = keep(__name__, "tokens", dict)
    h = np.fromiter([known.get(t) or _token_hash(t, known) for t in tokens], np.uint64, len(tokens))
    pairs = (h[:-1] * _MIX + h[1:]) * _MIX if h.size > 1 else h[:0]
    return np.unique(np.concatenate([np.unique(h), pairs]))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 30, tolerance: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of min |w|^2 / 2 + sum(cost * hinge). rows: feature places and values; y: 1 or -1."""
    w, alpha, rng = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    norms = np.array([float(v @ v) for _, v in rows])
    for _ in range(epochs):
        worst = 0.0
        for k in rng.permutation(len(rows)):
            at, values = rows[k]
            if norms[k] == 0:
                continue
            gradient = y[k] * float(w[at] @ values) - 1
            new = min(max(alpha[k] - gradient / norms[k], 0.0), cost[k])
            if new != alpha[k]:
                w[at] += (new - alpha[k]) * y[k] * values
                worst = max(worst, abs(new - alpha[k]) / cost[k])
                alpha[k] = new
        if worst < tolerance:
            break
    return w


@dataclass
class QualityModel:
    """ids: sorted feature ids; ratio: class log-count ratios; weight: of the scaled features, the bias last; sigmoid a, b."""

    ids: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    a: float
    b: float

    def row(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and unit-length values of a document's features, and the constant one."""
        if self.ids.size:
            at = np.minimum(np.searchsorted(self.ids, found), self.ids.size - 1)
            at = at[self.ids[at] == found]
        else:
            at = np.zeros(0, np.int64)
        values = self.ratio[at]
        length = np.sqrt(values @ values)
        return np.r_[at, self.ids.size], np.r_[values / length if length else values, 1.0]

    def margin(self, found: np.ndarray) -> float:
        at, values = self.row(found)
        return float(self.weight[at] @ values)


def fit(sample: list[np.ndarray], label: np.ndarray, counts: dict[int, int], smoothing: float = 1.0, cost: float = 1.0) -> QualityModel:
    """Fit on four fifths of the sample, calibrate on the rest. Without rows of both classes the score is their share."""
    held = np.arange(label.size) % 5 == 4
    train = [x for x, h in zip(sample, held, strict=True) if not h]
    y = label[~held]
    ids, seen = np.unique(np.concatenate(train), return_counts=True) if train else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    ids = ids[seen >= LEAST_DOCUMENTS]
    model = QualityModel(ids, np.zeros(ids.size), np.zeros(ids.size + 1), *fit_sigmoid(np.zeros(label.size), label, class_weights(label, counts)))
    if len(np.unique(y)) < 2:
        return model
    tally = np.full((2, ids.size), smoothing)
    for found, k in zip(train, y, strict=True):
        tally[k] += np.isin(ids, found, assume_unique=True)
    tally /= tally.sum(1, keepdims=True)
    model.ratio = np.log(tally[1] / tally[0])
    rows = [model.row(x) for x in train]
    weights = class_weights(y, {0: 1, 1: 1})
    model.weight = dual_coordinate_descent(rows, np.where(y == 1, 1.0, -1.0), ids.size + 1, cost * weights * 10)
    rest = [x for x, h in zip(sample, held, strict=True) if h] or train
    rest_label = label[held] if held.any() else y
    margins = np.array([model.margin(x) for x in rest])
    model.a, model.b = fit_sigmoid(margins, rest_label, class_weights(rest_label, counts))
    return model


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Learn labels.quality from at most per_class rows of each class whose crc32(doc_id) mod 5 isn't 0."""
    sample, counts = labelled_sample(docs, labels, "quality", per_class, *HELD_OUT)

    def make():
        return lambda part: {"doc_id": part.column(0), "found": [features(x).view(np.int64) for x in part.column(1).to_pylist()], "label": part.column(2)}

    rows = map_arrow(sample, make, "doc_id long, found array<long>, label int").toArrow().sort_by("doc_id")
    found = [np.asarray(x.values).view(np.uint64) for x in rows.column("found")]
    return fit(found, np.array(rows.column("label").to_pylist(), np.int64), counts)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; null and empty texts get the score of no features."""

    def make():
        def run(part: pa.RecordBatch) -> dict:
            margins = np.array([model.margin(features(x)) for x in part.column(1).to_pylist()])
            return {"doc_id": part.column(0), "score": pa.array(sigmoid(model.a * margins + model.b))}

        return run

    out = map_arrow(docs.select(column(docs, id_col, "doc_id", "long"), column(docs, text_col, "text", "string")), make, "doc_id long, score double")
    return out.select("doc_id", held_out_column(F.col("doc_id"), *HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The whole rows whose text scores THRESHOLD or more. Rows pass through as they are, without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            margins = np.array([model.margin(features(x)) for x in part.column(at).cast(pa.string()).to_pylist()])
            yield part.filter(pa.array(sigmoid(model.a * margins + model.b) >= THRESHOLD))
        give_back()

    return docs.mapInArrow(run, docs.schema)
