"""Operator 2, toxicity: maximum-scoring segments of token log-odds.

Tokens score by their log-odds in toxic against other texts under a Dirichlet prior; a form too rare
to judge takes the score of its longest telling prefix, as in languages that inflect. A linear-time
scan finds all maximal segments of positive score. Their scores follow an extreme-value law over
clean text, whose two constants are estimated on clean texts that gave no log-odds: over n tokens the
best score exceeds s with a chance of 1 - exp(-K n exp(-lambda s)). Scores normalised by it tell which
passages are significant, and are summed over a text and turned into a probability.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, materialize
from .learning import class_weights, fit_sigmoid, held_out_column, labelled_sample, sigmoid

#: The bound of the sample that is learned from: rows of each class.
PER_CLASS = 2000
HELD_OUT = (4, 2)
THRESHOLD = 0.3
#: The Dirichlet prior's weight as a share of all counts; the least z-score (a chance of 0.0013) and log-odds of a token that counts.
PRIOR, LEAST_Z, LEAST_ODDS = 0.05, 3.0, 1.5
#: The step down a token: a token of the least log-odds pays for six tokens between it and the next.
DRIFT = LEAST_ODDS / 6
#: The chance that a clean text has a significant passage.
ALPHA = 0.01
#: Parts of the sample: each calibrates with the log-odds that the others give.
FOLDS = 5
#: Prefixes of these lengths are counted beside whole tokens.
PREFIXES = (6, 5, 4, 3)

_TOKENS = re.compile(r"\w+").findall


def tokens(text: str | None) -> list[str]:
    return _TOKENS((text or "").lower())


def units(token: str) -> list[str]:
    """The token and its proper prefixes, marked by a star, longest first."""
    return [token, *(token[:k] + "*" for k in PREFIXES if len(token) > k)]


class Scores(dict):
    """Scores of tokens from those of units; each token is looked up once. 0.0: it doesn't count."""

    def __init__(self, by_unit: dict[str, float]):
        super().__init__()
        self.by_unit = by_unit

    def __missing__(self, token: str) -> float:
        found = next((self.by_unit[u] for u in units(token) if u in self.by_unit), 0.0)
        if len(self) > 500_000:
            self.clear()
        self[token] = found
        return found

    def __reduce__(self):
        return Scores, (self.by_unit,)


def log_odds(toxic: np.ndarray, clean: np.ndarray, share: float = PRIOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds ratios, z-scores and smoothed rates in clean text, under a Dirichlet prior in proportion to all counts."""
    n1, n0 = toxic.sum(), clean.sum()
    p = share * (toxic + clean)
    prior, a, b = p.sum(), toxic + p, clean + p
    delta = np.log(a / (n1 + prior - a)) - np.log(b / (n0 + prior - b))
    return delta, delta / np.sqrt(1 / a + 1 / b), b / (n0 + prior)


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in order, in linear time.

    Tokens at places have the scores given (before drift), all others 0; each token costs drift. Each
    candidate keeps the nearest earlier one whose left sum is lower, so no candidate is passed twice.
    """
    found: list[list] = []  # first, last, left sum, right sum, place of the nearest with a lower left sum
    total, before = 0.0, 0
    for at, value in zip(places, scores, strict=True):
        total -= drift * (at - before)
        before = at + 1
        step = value - drift
        left, total = total, total + step
        if step <= 0:
            continue
        new = [at, at, left, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def gumbel_rate(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * value)) = 1, which exists for a negative mean and a positive maximum."""
    if values.max(initial=0) <= 0 or (values * shares).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    moment = lambda r: float((shares * np.exp(np.minimum(r * values, 500))).sum())
    while moment(high) < 1:
        low, high = high, high * 2
    low = low or 1e-9
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    return (low + high) / 2


def fit_law(scored: list[tuple[int, list[float]]], values: np.ndarray, shares: np.ndarray, drift: float = DRIFT, weight: float = 5.0) -> tuple[float, float]:
    """(lambda, K) of the extreme-value law, of greatest likelihood for clean texts' best scores.

    scored: the texts' numbers of tokens, and the scores of their segments. A text without a segment
    has the best score 0 or less. Given lambda, the likelihood is greatest at K = texts with a segment
    / sum(n exp(-lambda best)). Where tokens are independent lambda is the root that gumbel_rate()
    finds for the token scores before drift, values, and their shares; that counts as much as weight
    texts, so that few texts with a segment don't mislead.
    """
    theory = gumbel_rate(values - drift, shares)
    known = [(n, max(found, default=0.0)) for n, found in scored if n]
    n, best = np.array(known, float).reshape(-1, 2).T
    hits = (best > 0).sum() + weight

    def scale(rate: float) -> float:
        return ((best > 0).sum() + 0.5) / (float(n @ np.exp(-rate * best)) + 1)

    def likelihood(rate: float) -> float:
        return hits * math.log(rate) + (best > 0).sum() * math.log(scale(rate)) - rate * (best.sum() + weight / theory)

    rate = max((theory * x for x in np.geomspace(0.02, 5, 400)), key=likelihood)
    return rate, scale(rate)


@dataclass
class ToxicityModel:
    """score: token scores before drift; rate and scale: the extreme-value law's lambda and K; sigmoid a, b."""

    score: Scores = field(default_factory=lambda: Scores({}))
    rate: float = 1.0
    scale: float = 0.1
    a: float = 0.0
    b: float = 0.0

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]], list[float]]:
        """The number of tokens, all segments (first token, last token, score), and the scores of the tokens that have one."""
        words = tokens(text)
        score = self.score
        places = [k for k, w in enumerate(words) if score[w]]
        values = [score[words[k]] for k in places]
        return len(words), segments(places, values, DRIFT), values

    def normal(self, n: int, scores: list[float]) -> list[float]:
        """Normalised scores lambda * s - ln(K * n): a clean text of n tokens exceeds v with a chance of 1 - exp(-exp(-v))."""
        base = math.log(self.scale * max(1, n))
        return [self.rate * s - base for s in scores]

    def passages(self, text: str | None, alpha: float | None = ALPHA) -> list[tuple[int, int, float]]:
        """Segments (first token, last token, normalised score) in order: those that a clean text has with a chance of alpha at most, or all for None."""
        n, found, _ = self.segments(text)
        least = -math.inf if alpha is None else -math.log(-math.log1p(-alpha))
        return [(a, b, v) for (a, b, _), v in zip(found, self.normal(n, [s for _, _, s in found])) if v > least]

    def statistic(self, text: str | None) -> float:
        n, found, _ = self.segments(text)
        return sum_statistic(self.normal(n, [s for _, _, s in found]))


def sum_statistic(values: list[float]) -> float:
    """How unlikely a clean text's normalised scores are, as a signed root of minus the logarithm of their chance; -5 without any.

    The r best sum to t or more with a chance of about exp(-t) t^(r-1) / (r! (r-1)!), which holds for
    t > r (r-1); for trying several r the chance is doubled with each. The least chance counts.
    """
    best, t = -25.0, 0.0
    for r, v in enumerate(sorted(values, reverse=True), 1):
        t += v
        if r == 1:
            best = max(best, t)
        elif t > r * (r - 1):
            best = max(best, t - (r - 1) * math.log(2 * t) + math.lgamma(r + 1) + math.lgamma(r))
        else:
            break
    return math.copysign(math.sqrt(abs(best)), best)


def unit_counts(sample: DataFrame) -> DataFrame:
    """(level, unit, toxic, clean, toxic_0, clean_0, toxic_1, ...): different contexts of each token and prefix, in all and in one fold alone.

    sample: text, label, fold. Copies of a text, however many, count once. level: the prefix's length,
    0 for whole tokens. Units that tell in none of the counts that unit_scores() takes, all or those
    without a fold, come summed, as one row a level with a null unit.
    """

    def make():
        def run(part: pa.RecordBatch) -> dict:
            seen = set()
            for text, label, fold in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                words = ["", *tokens(text), ""]
                seen.update((t, label, zlib.crc32(f"{a} {b}".encode("utf-8", "replace")), fold) for a, t, b in zip(words, words[1:-1], words[2:]))
            return dict(zip(("token", "label", "context", "fold"), map(list, zip(*seen)))) if seen else {k: [] for k in ("token", "label", "context", "fold")}

        return run

    each = map_arrow(sample.select("text", "label", "fold"), make, "token string, label int, context long, fold int")
    each = each.groupBy("token", "label", "context").agg(F.min("fold").alias("low"), F.max("fold").alias("high"))
    count = lambda k, f=None: F.count_if((F.col("label") == k) & (F.lit(True) if f is None else (F.col("low") == f) & (F.col("high") == f)))
    names = {"toxic": count(1), "clean": count(0)} | {f"{x}_{f}": count(k, f) for f in range(FOLDS) for x, k in (("toxic", 1), ("clean", 0))}
    by_token = each.groupBy("token").agg(*(c.alias(x) for x, c in names.items()))
    prefix = lambda k: F.when(F.length("token") > k, F.concat(F.substring("token", 1, k), F.lit("*")))
    sums = [F.sum(x).alias(x) for x in names]
    by_unit = by_token.select(F.explode(F.array_compact(F.array("token", *map(prefix, PREFIXES)))).alias("unit"), *names).groupBy("unit").agg(*sums)
    level = F.when(F.col("unit").endswith("*"), F.length("unit") - 1).otherwise(0)
    by_unit = materialize(by_unit.withColumn("level", level), "units")
    totals = {row["level"]: row.asDict() for row in by_unit.groupBy("level").agg(*sums).collect()}  # a row for each of the levels
    tells = reduce(lambda a, b: a | b, [_tells(totals[k], f) & (F.col("level") == k) for k in totals for f in (None, *range(FOLDS))], F.lit(False))
    return by_unit.groupBy("level", F.when(tells, F.col("unit")).alias("unit")).agg(*sums)


def _tells(total: dict, without: int | None) -> Column:
    """Whether a unit's z-score and log-odds reach their limits, given its level's totals, but for rounding. As log_odds()."""
    toxic, clean = ((F.col(c) - F.col(f"{c}_{without}"), total[c] - total[f"{c}_{without}"]) if without is not None else (F.col(c), total[c]) for c in ("toxic", "clean"))
    if not toxic[1] or not clean[1]:
        return F.lit(False)
    prior = PRIOR * (toxic[1] + clean[1])
    p = (toxic[0] + clean[0]) * F.lit(PRIOR)
    a, b = toxic[0] + p, clean[0] + p
    delta = F.ln(F.try_divide(a, F.lit(toxic[1] + prior) - a)) - F.ln(F.try_divide(b, F.lit(clean[1] + prior) - b))
    return F.coalesce((delta >= LEAST_ODDS - 1e-9) & (delta / F.sqrt(F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b)) >= LEAST_Z - 1e-9), F.lit(False))


def unit_scores(rows: list[dict], without: int | None = None) -> dict[str, float]:
    """The log-odds of the units that tell, from rows of unit_counts(), or from those contexts that aren't in one fold alone."""
    scores = {}
    for k in (*PREFIXES, 0):
        own = [row for row in rows if row["level"] == k]
        toxic, clean = (np.array([row[c] - (row[f"{c}_{without}"] if without is not None else 0) for row in own], float) for c in ("toxic", "clean"))
        own = [row for row, n in zip(own, toxic + clean, strict=True) if n]
        toxic, clean = toxic[toxic + clean > 0], clean[toxic + clean > 0]
        if toxic.sum() and clean.sum():
            delta, z, _ = log_odds(toxic, clean)
            scores |= {row["unit"]: float(d) for row, d, x in zip(own, delta, z, strict=True) if row["unit"] is not None and x >= LEAST_Z and d >= LEAST_ODDS}
    return scores


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Learn labels.toxic from at most per_class rows of each class whose crc32(doc_id) mod 4 isn't 2.

    All of them give the log-odds. The extreme-value law and the sigmoid are fitted on the scores that
    each fold gets from the log-odds of the others, so on rows that the counts haven't seen. Without
    toxic rows every text scores near 0.
    """
    sample, counts = labelled_sample(docs, labels, "toxic", per_class, *HELD_OUT)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    table = unit_counts(sample).toArrow().sort_by([("level", "ascending"), ("unit", "ascending")]).to_pylist()
    model = ToxicityModel(Scores(unit_scores(table)))
    parts = [ToxicityModel(Scores(unit_scores(table, f))) for f in range(FOLDS)]

    def measured():
        def run(part: pa.RecordBatch) -> dict:
            found = [parts[f].segments(x) for x, f in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)]
            return {"doc_id": part.column(0), "label": part.column(2), "n": [n for n, _, _ in found], "scores": [[s for _, _, s in x] for _, x, _ in found], "values": [x for _, _, x in found]}

        return run

    # At most 2 * per_class rows of numbers.
    rows = map_arrow(sample.select("doc_id", "text", "label", "fold"), measured, "doc_id long, label int, n long, scores array<double>, values array<double>").toArrow().sort_by("doc_id").to_pylist()
    clean = [r for r in rows if r["label"] == 0]
    if total := sum(r["n"] for r in clean):
        values, times = np.unique(np.concatenate([np.array(r["values"], float) for r in clean]), return_counts=True)
        model.rate, model.scale = fit_law([(r["n"], r["scores"]) for r in clean], np.r_[values, 0.0], np.r_[times, total - times.sum()] / total)
    label = np.array([r["label"] for r in rows], np.int64)
    if label.size:
        t = np.array([sum_statistic(model.normal(r["n"], r["scores"])) for r in rows])
        model.a, model.b = fit_sigmoid(t, label, class_weights(label, counts))
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every whole text.

    passages: array<struct<first, last, score>>, the significant segments by token number: each is as
    good as a clean text's best with a chance of ALPHA at most. Null, empty
    and wordless texts have none and get the lowest score.
    """

    def make():
        def run(part: pa.RecordBatch) -> dict:
            texts = part.column(1).to_pylist()
            found = [[{"first": a, "last": b, "score": v} for a, b, v in model.passages(x)] for x in texts]
            values = np.array([model.statistic(x) for x in texts])
            return {"doc_id": part.column(0), "score": pa.array(sigmoid(model.a * values + model.b)), "passages": found}

        return run

    out = map_arrow(docs.select(column(docs, id_col, "doc_id", "long"), column(docs, text_col, "text", "string")), make, "doc_id long, score double, passages array<struct<first: int, last: int, score: double>>")
    return out.select("doc_id", held_out_column(F.col("doc_id"), *HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
