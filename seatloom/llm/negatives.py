"""Operator 13, hard-negative mining by distributed radix selection.

Anchors are compared with all rows, a block of anchors with a block of rows at a time. What is looked
for is always the first k rows of a window of integer scores, highest first and of equal scores the
smallest ids. A pass makes, for each anchor and window, a histogram of one digit of the scores;
summed over all blocks it tells in which bucket the kth row lies. The next pass looks at that bucket
only, a digit further, and once scores are told apart, at the digits of the ids among equal ones.
When a bucket holds few rows, those that qualify are gathered, a few for each window. A block's
histogram ends with the bucket in which its own kth row lies, so it has k buckets at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize

#: Rows and anchors in a block at most; about so many for anchors, which a hash deals out.
ROW_BLOCK, ANCHOR_BLOCK = 2048, 512
#: Bits of a digit.
DIGIT = 10
#: A bucket of so many times k rows is gathered rather than cut further.
FEW = 4

#: How many buckets' bits still lie below the present digit, and which rows of which scores and ids the window now holds.
_STATE = "w int, same boolean, k long, top long, lo long, hi long, ilo long, ihi long, shift int, phase int"
_SCORES, _IDS, _DONE = range(3)


def packed(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, vector) as blocks (block, n, ids, labels, data): little-endian 64-bit integers, vectors filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                ids, labels = (part.column(k).to_numpy() for k in (0, 1))
                data = _matrix(part.column(2))
                columns = [[int(ids.min())], [part.num_rows], [ids.tobytes()], [labels.tobytes()], [data.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["block", "n", "ids", "labels", "data"])

    return rows.select("vec_id", "label", "vector").mapInArrow(run, "block long, n long, ids binary, labels binary, data binary")


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A list column as a matrix of 64-bit integers; shorter rows are filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, out = vectors.flatten().to_numpy(), np.zeros((len(vectors), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all rows of b; where a 64-bit integer may not hold them it is an error."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, width)
    if most < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("inner products beyond 64 bits")
    return a @ b.T


def _windows(anchors: pa.StructArray) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Windows of a block's anchors, one of each anchor at a time: (the anchors' places, the state's columns)."""
    lists = anchors.field("windows")
    at, ends = lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:]
    fields = {f.name: lists.values.field(f.name).to_numpy(zero_copy_only=False) for f in lists.type.value_type}
    for nth in range(int((ends - at).max(initial=0))):
        own = np.nonzero(at + nth < ends)[0]
        yield own, {name: x[at[own] + nth] for name, x in fields.items()}


def _compared(pairs: DataFrame, each: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """each(ids, scores, inside, window, anchor ids) over every window of every pair of blocks.

    inside: the rows of the window's kind (of the anchor's label but not of its id, or of another label)
    whose scores lie from lo to top.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                n = row.column(0)[0].as_py()
                ids, labels = (np.frombuffer(row.column(c)[0].as_buffer(), np.int64) for c in (1, 2))
                data = np.frombuffer(row.column(3)[0].as_buffer(), np.int64).reshape(n, -1)
                anchors = row.column(4).flatten()
                anchor_ids, anchor_labels = (anchors.field(c).to_numpy() for c in ("vec_id", "label"))
                scores = inner_products(_matrix(anchors.field("vector")), data)
                alike = anchor_labels[:, None] == labels
                other = ~alike
                alike &= anchor_ids[:, None] != ids
                for own, w in _windows(anchors):
                    here = scores[own]
                    inside = np.where(w["same"][:, None], alike[own], other[own]) & (here >= w["lo"][:, None]) & (here <= w["top"][:, None])
                    found = each(ids, here, inside, w, anchor_ids[own])
                    if found["anchor_id"].size:
                        yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in names], names)
        give_back()

    return pairs.select("n", "ids", "labels", "data", "anchors").mapInArrow(run, schema)


def _histogram(ids: np.ndarray, scores: np.ndarray, inside: np.ndarray, w: dict[str, np.ndarray], anchor_ids: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by digit, the bucket that comes first in order 0, up to that of the block's own kth row."""
    by_id = (w["phase"] == _IDS)[:, None]
    inside = inside & (scores <= w["hi"][:, None]) & (~by_id | ((ids >= w["ilo"][:, None]) & (ids <= w["ihi"][:, None])))
    i, j = np.nonzero(inside)
    value = np.where(by_id[i, 0], ids[j] - w["ilo"][i], w["hi"][i] - scores[i, j])
    width = 1 << DIGIT
    counts = np.bincount(i * width + (value >> w["shift"][i]), minlength=scores.shape[0] * width).reshape(-1, width)
    before = np.cumsum(counts, axis=1) - counts
    i, digit = np.nonzero((counts > 0) & (before < w["k"][:, None]))
    return {"anchor_id": anchor_ids[i], "w": w["w"][i].astype(np.int32), "digit": digit, "n": counts[i, digit]}


def _gathered(ids: np.ndarray, scores: np.ndarray, inside: np.ndarray, w: dict[str, np.ndarray], anchor_ids: np.ndarray) -> dict[str, np.ndarray]:
    """Rows above the last bucket found, and those in it."""
    i, j = np.nonzero(inside & ((scores > w["hi"][:, None]) | (ids <= w["ihi"][:, None])))
    return {"anchor_id": anchor_ids[i], "w": w["w"][i].astype(np.int32), "vec_id": ids[j], "score": scores[i, j]}


def _bits(n: Column) -> Column:
    """How many bits below the first digit of numbers up to n."""
    return F.greatest(F.length(F.bin(n)) - DIGIT, F.lit(0)).cast("int")


def _next(state: DataFrame, counts: DataFrame) -> DataFrame:
    """The windows' state once each has been cut to the bucket in which its kth row lies."""
    order = Window.partitionBy("anchor_id", "w").orderBy("digit")
    summed = counts.groupBy("anchor_id", "w", "digit").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(order))
    limits = state.select("vec_id", F.col("w").alias("sw"), "k")
    hit = summed.join(limits, (F.col("anchor_id") == F.col("vec_id")) & (F.col("w") == F.col("sw")))
    hit = hit.groupBy("anchor_id", F.col("sw").alias("hw")).agg(F.min(F.when(F.col("upto") >= F.col("k"), F.struct("digit", "n", "upto"))).alias("hit"))
    rows = state.join(hit, (F.col("vec_id") == F.col("anchor_id")) & (F.col("w") == F.col("hw")), "left").drop("anchor_id", "hw")
    here, ids = F.col("hit").isNotNull(), F.col("phase") == _IDS
    span = F.expr("shiftleft(1L, shift)")
    begin = F.expr("shiftleft(hit.digit, shift)")
    hi = F.when(ids | ~here, F.col("hi")).otherwise(F.col("hi") - begin)
    lo = F.when(ids | ~here, F.col("lo")).otherwise(F.greatest("lo", hi - span + 1))
    ilo = F.when(ids & here, F.col("ilo") + begin).otherwise(F.col("ilo"))
    ihi = F.when(ids & here, F.least("ihi", F.col("ilo") + begin + span - 1)).otherwise(F.col("ihi"))
    few = ~here | (F.col("hit.n") <= FEW * F.col("k"))
    told = F.col("shift") == 0
    phase = F.when(few | (ids & told), _DONE).when(told, _IDS).otherwise(F.col("phase"))
    shift = F.when(told, _bits(F.col("ihi") - F.col("ilo"))).otherwise(F.greatest(F.col("shift") - DIGIT, F.lit(0)))
    k = F.when(here, F.col("k") - F.col("hit.upto") + F.col("hit.n")).otherwise(F.col("k"))
    return rows.select(*(c for c in state.columns if c not in ("k", "lo", "hi", "ilo", "ihi", "shift", "phase")), k.alias("k"), lo.alias("lo"), hi.alias("hi"), ilo.alias("ilo"), ihi.alias("ihi"), shift.cast("int").alias("shift"), phase.cast("int").alias("phase"))


def _pairs(blocks: DataFrame, anchors: DataFrame, state: DataFrame, anchor_blocks: int) -> DataFrame:
    """Blocks of rows joined to blocks of anchors that still have windows: every pair once, spread over all tasks.

    The partitions are as many as asked for: what they read is small against what they compute, so they mustn't be merged by size.
    """
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = max(1, -(-2 * tasks // anchor_blocks))
    fields = [x.split()[0] for x in _STATE.split(", ")]
    windows = state.groupBy(F.col("vec_id").alias("owner")).agg(F.collect_list(F.struct(*fields)).alias("windows"))
    busy = anchors.join(windows, F.col("vec_id") == F.col("owner"))
    held = busy.groupBy("nth").agg(F.collect_list(F.struct("vec_id", "label", "vector", "windows")).alias("anchors"))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumnRenamed("nth", "to")
    dealt = blocks.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)))).withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int"))
    return dealt.repartition(tasks, "nth", "deal").join(held.repartition(tasks, "to", "part"), (F.col("nth") == F.col("to")) & (F.col("deal") == F.col("part")))


def first_rows(blocks: DataFrame, anchors: DataFrame, state: DataFrame, anchor_blocks: int, k: int) -> DataFrame:
    """(anchor_id, w, vec_id, score, rank): the first k rows of each window, by radix selection.

    state: vec_id of the anchor and _STATE, all with the same k. The number of passes is that of the digits of
    scores and ids at most; windows that are settled drop out of them.
    """
    settled = []
    while True:
        state = materialize(state, "windows")
        settled.append(state.where(F.col("phase") == _DONE))
        state = state.where(F.col("phase") != _DONE)
        if state.isEmpty():
            break
        counts = _compared(_pairs(blocks, anchors, state, anchor_blocks), _histogram, "anchor_id long, w int, digit long, n long")
        state = _next(state, counts)
    last = settled[0]
    for more in settled[1:]:
        last = last.unionByName(more)
    rows = _compared(_pairs(blocks, anchors, last, anchor_blocks), _gathered, "anchor_id long, w int, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id long, label long, vector array<long>).

    Scores are integer inner products; higher ones come first, ties by smaller vec_id. An anchor's
    positives are its first rows of the same label and another id. For each, the negatives are the
    first rows of another label whose score has low to high percent of the positive's. Rows with a null
    anywhere take no part. Shorter vectors are filled up with zeros. Rows that share an id are rows
    of their own, but one anchor: that of the least label, then vector. Every row is compared with
    every anchor; no partner is left out, and a vector that many rows share costs digits of ids, not
    memory. Scores that 64-bit integers can't hold are an error.
    """
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<bigint>")).where(whole)
    blocks = materialize(packed(rows), "blocks")
    chosen = materialize(rows.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.label", "x.vector"), "chosen")
    anchor_blocks = max(1, -(-chosen.count() // ANCHOR_BLOCK))
    anchors = materialize(chosen.withColumn("nth", F.pmod(F.xxhash64("vec_id"), F.lit(anchor_blocks)).cast("int")), "anchors")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    limits = rows.agg(F.sqrt(F.max(square("vector"))).alias("norm"), F.min("vec_id").alias("ilo"), F.max("vec_id").alias("ihi")).first()
    bound = F.least(F.ceil(F.sqrt(square("vector")) * F.lit(limits.norm or 0.0) * F.lit(1.0 + 1e-9)) + 1, F.lit(float(1 << 62))).cast("long")
    ids = [F.lit(limits.ilo or 0).cast("long").alias("ilo"), F.lit(limits.ihi or 0).cast("long").alias("ihi")]

    def windows(of: DataFrame, w: Column, same: bool, k: int, lo: Column, hi: Column) -> DataFrame:
        made = of.select("vec_id", w.cast("int").alias("w"), F.lit(same).alias("same"), F.lit(k).cast("long").alias("k"), hi.cast("long").alias("top"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), *ids)
        return made.withColumns({"shift": _bits(F.col("hi") - F.col("lo")), "phase": F.lit(_SCORES)})

    near = first_rows(blocks, anchors, windows(anchors, F.lit(0), True, positives, -bound, bound), anchor_blocks, positives)
    near = materialize(near.select("anchor_id", F.col("rank").cast("int").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(38,0)")
    span = near.select(F.col("anchor_id").alias("vec_id"), "w", F.ceil(score * low / 100).alias("from"), F.floor(score * high / 100).alias("to")).where("from <= to")
    far = first_rows(blocks, anchors, windows(span, F.col("w"), False, negatives, F.col("from"), F.col("to")), anchor_blocks, negatives)
    far = far.select("anchor_id", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(near, ["anchor_id", "w"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
