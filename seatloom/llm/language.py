"""Operator 8, language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties, then calibrated by a
temperature fitted on a part of the sample that the model hasn't seen.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, id_remainder, map_arrow, materialize
from .learning import held_out_column

#: The bound of the sample that is learned from: documents of each language, and of all together, but for one of each language.
PER_LANGUAGE, TOTAL = 600, 6000
#: The bound of the sample's n-grams, each counted once a document; the first document of each language comes on top.
GRAMS = 1 << 24
#: Parts of a language's hashes for each document that is wanted of it; each part gives one at most.
PARTS = 4
HELD_OUT = (5, 0)
#: Buckets of n-grams, as a power of two, and the bound of buckets times languages, beyond which there are fewer buckets.
BUCKET_BITS, STATE_BITS = 15, 26
ORDERS = (1, 2, 3)
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}").search


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def bucket_bits(classes: int) -> int:
    """BUCKET_BITS for up to 2,048 languages; for more as many as keep the training state, 8 bytes for each bucket and language, within 0.5 GB."""
    return max(1, min(BUCKET_BITS, STATE_BITS - max(0, classes - 1).bit_length()))


def ngrams(text: str | None, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of hashed character 1- to 3-grams. Letters in lower case, anything else a single space."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[codes], codes, 32)
    space = codes == 32
    codes = codes[~(space & np.r_[False, space[:-1]])]
    grams, found = codes, []
    for order in ORDERS:
        if order > 1:
            grams = grams[:-1] * np.uint32(0x01000193) + codes[order - 1 :]
        found.append((grams * np.uint32(2654435761) + np.uint32(order)) >> np.uint32(32 - bits))
    counts = np.bincount(np.concatenate(found), minlength=1 << bits)
    at = np.nonzero(counts)[0]
    return at, counts[at]


@dataclass
class LanguageModel:
    """Weights are kept by bucket, without zeros: those of bucket b are value[start[b]:start[b + 1]] for languages of[...]."""

    languages: list[str]
    idf: np.ndarray
    start: np.ndarray
    of: np.ndarray
    value: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    bits: int = BUCKET_BITS

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = np.log1p(counts) * self.idf[at]
        length = np.sqrt(values @ values)
        return values / length if length else values

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first = self.start[at]
        sizes = self.start[at + 1] - first
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if ends.size else 0) + np.repeat(first - (ends - sizes), sizes)
        return self.bias + np.bincount(self.of[places], np.repeat(self.vector(at, counts), sizes) * self.value[places], self.bias.size)

    def probabilities(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logits = self.logits(at, counts) / self.temperature
        p = np.exp(logits - logits.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not _LETTER(text):
            return UNKNOWN, 0.0
        p = self.probabilities(*ngrams(text, self.bits))
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, size: int, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> np.ndarray:
    """Weights (size, classes) by follow-the-regularised-leader on the softmax loss, an elastic net on them. rows: feature places and values.

    The state is two single-precision arrays of that shape; a step touches a row's features alone.
    """
    z, n = np.zeros((size, classes), np.float32), np.zeros((size, classes), np.float32)
    rng = np.random.default_rng(seed)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, np.float32(0), -(zs - np.sign(zs) * np.float32(l1)) / ((np.float32(beta) + np.sqrt(ns)) / np.float32(alpha) + np.float32(l2)))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x = rows[k]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label[k]] -= 1
            g = x[:, None] * p
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / np.float32(alpha) * w
            n[at] = more
    for at in range(0, size, 1024):  # the weights take the place of z, some features at a time
        z[at : at + 1024] = weights(z[at : at + 1024], n[at : at + 1024])
    return z


def fit_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature, of 200 between 0.05 and 20, at which the labels are likeliest."""

    def loss(t: float) -> float:
        scaled = logits / t
        top = scaled.max(1, keepdims=True)
        return float((np.log(np.exp(scaled - top).sum(1)) + top[:, 0] - scaled[np.arange(label.size), label]).mean())

    return float(min(np.geomspace(0.05, 20, 200), key=loss))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, languages: list[str], epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, seed: int = 7, bits: int = BUCKET_BITS) -> LanguageModel:
    """FTRL over buckets that occur in the sample; every fifth row of each language is kept for the temperature, so each has one that is trained on."""
    size, classes = 1 << bits, len(languages)
    order = np.argsort(label, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(label, minlength=classes))][label[order]] if label.size else order
    held = np.zeros(label.size, bool)
    held[order] = (np.arange(label.size) - starts) % 5 == 4
    train = np.nonzero(~held)[0]
    seen = np.bincount(np.concatenate([rows[k][0] for k in train]) if train.size else np.zeros(0, np.int64), minlength=size)
    nothing = np.zeros(0, np.int64)
    model = LanguageModel(languages, np.log((1 + train.size) / (1 + seen)) + 1, np.zeros(size + 1, np.int64), nothing, np.zeros(0, np.float32), np.zeros(classes), bits=bits)
    if classes < 2:
        return model
    known = np.nonzero(seen)[0]
    place = np.cumsum(seen > 0) - 1
    vectors = [(np.r_[place[rows[k][0]], known.size], np.r_[model.vector(*rows[k]), 1.0].astype(np.float32)) for k in train]
    weight = ftrl(vectors, label[train], known.size + 1, classes, epochs, alpha, beta, l1, l2, seed)
    model.bias = weight[-1].astype(float)
    features, model.of = np.nonzero(weight[:-1])
    model.value = weight[features, model.of]
    model.of = model.of.astype(np.int32)
    model.start[1:] = np.cumsum(np.bincount(known[features], minlength=size))
    rest = np.nonzero(held)[0] if held.any() else train
    if rest.size:
        model.temperature = fit_temperature(np.stack([model.logits(*rows[k]) for k in rest]), label[rest])
    return model


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> tuple[list[str], DataFrame]:
    """All languages, and (lang, place, text) of the documents that are learned from, their place in their language from 1.

    Null texts and languages and ids with the held-out remainder take no part. Documents are told apart
    by id, text and language, so repeated rows count once and rows that share an id don't. Hashes of a
    language's documents fall in PARTS times as many parts as documents are wanted (the smaller of
    per_language and an equal share of total); the least hash of each part is found by an aggregate that
    is bounded by parts, not documents, and the least of those are taken. Every language has one at least.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1]))
    languages = sorted(row.lang for row in rows.select("lang").distinct().collect())  # one row a language, each a class of the model
    each = min(per_language, max(1, total // max(1, len(languages))))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text", "lang"))
    least = rows.groupBy("lang", F.pmod("key", F.lit(each * PARTS)).alias("part")).agg(F.min("key").alias("key"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")  # at most each * PARTS rows a language
    keys = least.select(F.col("lang").alias("lang_of"), F.col("key").alias("key_of"), F.row_number().over(order).alias("place")).where(F.col("place") <= each)
    # At most total rows and one for each class of the model.
    found = rows.join(F.broadcast(keys), (F.col("key") == F.col("key_of")) & (F.col("lang") == F.col("lang_of")))
    return languages, found.groupBy("lang", "place").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL, grams: int = GRAMS) -> LanguageModel:
    """Learn from the documents of sample(), whole texts, in the order of their places while their n-grams number grams at most.

    The first document of each language is always learned from, so every language is, however many
    there are. Empty input gives a model that knows no language.
    """
    languages, chosen = sample(docs, per_language, total)
    bits = bucket_bits(len(languages))

    def make():
        def run(part: pa.RecordBatch) -> dict:
            found = [ngrams(x, bits) for x in part.column(2).to_pylist()]
            return {"lang": part.column(0), "place": part.column(1), "size": [at.size for at, _ in found], "at": [at.astype(np.int32) for at, _ in found], "n": [n.astype(np.int32) for _, n in found]}

        return run

    rows = materialize(map_arrow(chosen.select("lang", "place", "text"), make, "lang string, place int, size long, at array<int>, n array<int>"), "grams")
    sizes = rows.groupBy("place").agg(F.sum("size").alias("size")).orderBy("place").collect()  # at most per_language rows
    sums = np.cumsum([row["size"] for row in sizes])
    last = max([1, *(row.place for row, n in zip(sizes, sums, strict=True) if n <= grams)])
    table = rows.where(F.col("place") <= last).toArrow().sort_by([("place", "ascending"), ("lang", "ascending")])
    index = {x: k for k, x in enumerate(languages)}
    data = [(np.asarray(a.values), np.asarray(c.values)) for a, c in zip(table.column("at"), table.column("n"), strict=True)]
    return fit(data, np.array([index[x] for x in table.column("lang").to_pylist()], np.int64), languages, bits=bits)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text. A text that is null or has no letter: und, 0."""

    def make():
        def run(part: pa.RecordBatch) -> dict:
            found = [model.predict(x) for x in part.column(1).to_pylist()]
            return {"doc_id": part.column(0), "lang_pred": [x for x, _ in found], "score": [p for _, p in found]}

        return run

    out = map_arrow(docs.select(column(docs, id_col, "doc_id", "long"), column(docs, text_col, "text", "string")), make, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out_column(F.col("doc_id"), *HELD_OUT).alias("held_out"), "lang_pred", "score")
