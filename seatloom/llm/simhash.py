"""Operator 6, SimHash near-dedup: 64-bit fingerprints of word shingles, linked by exact tiled comparison.

Distinct fingerprints are put in order of their population counts and cut in tiles of one count each;
tiles are compared in full with numpy exclusive-or and bit counts, and tile pairs whose counts differ
beyond the radius are skipped. That happens inside buckets of fingerprints that agree on a choice of bit
blocks. Every link lies in one bucket at least, so none is missed, and no bucket is capped. The
number of blocks follows from the number of fingerprints, so that buckets of random fingerprints stay
small; within a bucket the work is the square of its size, less what is skipped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, join_crowded, map_arrow, materialize
from .components import connected_components
from .lines import _filtered

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints that are shipped together at most, and in a tile of the comparison.
CHUNK, TILE = 8192, 64
#: What it costs to put a fingerprint in one more bucket, in comparisons.
SHIP_COST = 2000
#: Links that are gathered before they are united.
LINKS_AT_ONCE = 1 << 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of a text. Words are runs of anything but ASCII white space, A to Z lower-cased; no word gives 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[len(ends) - n :].tolist(), strict=True)]
    octets = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _PLACES).reshape(-1), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.reshape(-1) > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, seed: int = SEED, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp[, long columns to carry]): the fingerprint of every row as a signed long; null texts have 0."""
    extra = carry or {}
    names = list(extra)

    def make():
        def run(part: pa.RecordBatch) -> dict:
            values = np.array([fingerprint(x, shingle, seed) for x in part.column(1).to_pylist()], np.uint64)
            return {"doc_id": part.column(0), "fp": pa.array(values.view(np.int64))} | {name: part.column(2 + k) for k, name in enumerate(names)}

        return run

    rows = df.select(column(df, id_col, "doc_id", "long"), column(df, text_col, "text", "string"), *(c.alias(name) for name, c in extra.items()))
    return map_arrow(rows, make, ", ".join(f"{name} long" for name in ("doc_id", "fp", *extra)))


def tiles(bits: np.ndarray, tile: int = TILE) -> np.ndarray:
    """Where tiles begin, and the end: a tile has one population count and tile fingerprints at most. bits: population counts in ascending order."""
    begins = np.nonzero(np.r_[True, bits[1:] != bits[:-1]])[0]
    sizes = np.diff(np.append(begins, bits.size))
    more = -(-sizes // tile)
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    return np.append(np.repeat(begins, more) + nth * tile, bits.size)


def tile_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool, tile: int = TILE) -> tuple[list[tuple[int, int, int, int]], int]:
    """Pairs of tiles that must be compared, as their begins and ends in a and b, and how many were skipped.

    a, b: population counts in ascending order. same: a and b are one list, of which each pair of
    tiles comes once. Tiles have one count each, so those to compare with are neighbours in b's order.
    """
    cut_a, cut_b = tiles(a, tile), tiles(b, tile)
    of_b = b[cut_b[:-1]]
    pairs, skipped = [], 0
    for i, (low, high) in enumerate(zip(cut_a[:-1].tolist(), cut_a[1:].tolist())):
        least = i if same else 0
        first, last = np.searchsorted(of_b, a[low] - radius), np.searchsorted(of_b, a[low] + radius, side="right")
        near = range(max(least, int(first)), int(last))
        pairs += [(low, high, int(cut_b[j]), int(cut_b[j + 1])) for j in near]
        skipped += of_b.size - least - len(near)
    return pairs, skipped


def linked(a: np.ndarray, b: np.ndarray, radius: int, same: bool = False, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a and b that differ in at most radius bits, a tile pair at a time."""
    bits_a, bits_b = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    order_a, order_b = np.argsort(bits_a, kind="stable"), np.argsort(bits_b, kind="stable")
    sorted_a, sorted_b = a[order_a], b[order_b]
    for i, i_end, j, j_end in tile_pairs(bits_a[order_a], bits_b[order_b], radius, same, tile)[0]:
        x, y = np.nonzero(np.bitwise_count(sorted_a[i:i_end, None] ^ sorted_b[None, j:j_end]) <= radius)
        if x.size:
            yield order_a[x + i], order_b[y + j]


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same index pairs in longer arrays."""
    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += pair[0].size
        if size >= LINKS_AT_ONCE:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def spanning_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """A spanning forest of the links between two tiles, as index pairs into a followed by b.

    It joins what the links join with fewer rows than fingerprints. Links are united some at a
    time by hooking roots on the least neighbouring root and halving paths, all in numpy.
    """
    offset = 0 if same else a.size
    root, kept = np.arange(offset + b.size), []
    for i, j in _gathered(linked(a, b, radius, same)):
        j = j + offset
        while True:
            while (root[root] != root).any():
                root = root[root]
            x, y = root[i], root[j]
            apart = np.nonzero(x != y)[0]
            if not apart.size:
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            first = order[np.r_[True, np.diff(high[order]) > 0]]
            root[high[first]] = low[first]
            kept.append(np.stack([i[first], j[first]], 1))
    return np.concatenate(kept) if kept else np.empty((0, 2), np.int64)


def _compare(rows: DataFrame, radius: int) -> DataFrame:
    """Compare tiles: rows of fps1 with themselves where fps2 is null, else with fps2. Links come as (fp_a, fp_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                one, two = (batch.column(i)[k] for i in (0, 1))
                a, same = one.values.to_numpy().view(np.uint64), not two.is_valid
                b = a if same else two.values.to_numpy().view(np.uint64)
                pair = spanning_links(a, b, radius, same)
                if len(pair):
                    found.append((a if same else np.concatenate([a, b]))[pair].view(np.int64))
            if found:
                found = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["fp_a", "fp_b"])

    return rows.select("fps1", "fps2").mapInArrow(run, "fp_a long, fp_b long")


def block_count(n: int, radius: int) -> int:
    """In how many bit blocks n fingerprints are cut: the number that costs least where they are random.

    With b blocks there are C(b, radius) choices of b - radius blocks, which hold 64 (b - radius) / b bits.
    """
    cost = lambda b: math.comb(b, radius) * (SHIP_COST + n / 2 ** (64 * (b - radius) // b))
    return min(range(radius + 1, radius + 5), key=cost)


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask for each choice of blocks - radius blocks: two fingerprints within the radius agree on one choice at least."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    own = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(x) for x in itertools.combinations(own, blocks - radius)]


def links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, blocks: int | None = None) -> DataFrame:
    """Links between distinct fingerprints within radius, reduced to a spanning forest of each comparison: (fp_a, fp_b).

    distinct: fp, each once. blocks follows from their number if it isn't given. Fingerprints that
    agree on a choice of blocks - radius of the blocks are a bucket. A bucket of at most chunk
    fingerprints travels as one row. A larger one is cut by population count, and by a hash where one
    count alone is too many; its chunks are paired, but for pairs whose population counts differ by
    more than the radius. In every row tiles are compared as spanning_links() says. Fingerprints
    travel in chunks, never in pairs.
    """
    blocks = blocks or block_count(distinct.count(), radius)
    masked = [F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in block_masks(blocks, radius)]
    banded = distinct.select("fp", F.posexplode(F.array(*masked)).alias("block", "value"))
    key = ["block", "value"]
    crowded = materialize(banded.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > chunk).select(*key, F.lit(True).alias("crowded")), "crowded")
    dealt = banded.join(crowded, key, "left")
    alone = dealt.where("crowded is null").groupBy(key).agg(F.collect_list("fp").alias("fps1")).where("size(fps1) > 1").select("fps1", F.lit(None).cast("array<bigint>").alias("fps2"))
    cell = [*key, "bits"]
    many = dealt.where("crowded").select(*key, "fp", F.bit_count("fp").cast("int").alias("bits"))
    counts = materialize(many.groupBy(cell).agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks")), "counts")
    cut = many.join(counts, cell).select(*cell, F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("k"), "fp")
    cut = materialize(cut.groupBy(*cell, "k").agg(F.collect_list("fp").alias("fps")), "chunks")
    one = cut.select(*key, F.col("bits").alias("b1"), F.col("k").alias("k1"))
    two = cut.select(*key, F.col("bits").alias("b2"), F.col("k").alias("k2"))
    pairs = one.join(two, key).where(f"(b2 > b1 and b2 - b1 <= {radius}) or (b1 = b2 and k1 <= k2)")
    chunk_of = lambda n: cut.select(*key, F.col("bits").alias(f"b{n}"), F.col("k").alias(f"k{n}"), F.col("fps").alias(f"fps{n}"))
    crossed = pairs.join(chunk_of(1), [*key, "b1", "k1"]).join(chunk_of(2), [*key, "b2", "k2"]).select("fps1", F.when(F.expr("b1 <> b2 or k1 <> k2"), F.col("fps2")).alias("fps2"))
    return _compare(alone, radius).unionByName(_compare(crossed, radius)).distinct()


def groups(docs: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(f, part) for each different fingerprint of docs (fp): part is the least fingerprint that a chain of links reaches."""
    nodes = materialize(docs.select("fp").distinct(), "nodes")
    parts = connected_components(materialize(links(nodes, radius, chunk), "links"), "fp_a", "fp_b").select("node", "component")
    return materialize(nodes.join(parts, nodes.fp == parts.node, "left").select(F.col("fp").alias("f"), F.coalesce("component", "fp").alias("part")), "groups")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of df.

    component_id is the smallest doc_id that a chain of links reaches, the row's own included. Equal
    fingerprints are one node, so a group of copies of any size is one row of the comparison. Rows
    that share an id but not a text are documents of their own. Null and wordless texts have
    fingerprint 0 and are linked like any other; a row with a null id gets its group's component but
    never names one (a group of nulls: null). An empty df gives an empty result.
    """
    docs = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    parts = groups(docs, radius, chunk)
    each = docs.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).join(parts, F.col("fp") == F.col("f"))
    each = materialize(each.select("f", "id", "n", F.col("part").alias("own")), "members")
    least = materialize(each.groupBy("own").agg(F.min("id").alias("component_id")).withColumnRenamed("own", "part"), "least")
    named = materialize(each.join(least, F.col("own") == F.col("part")).select("f", "n", "component_id"), "components")
    return join_crowded(docs, named, [("fp", "f")], "n", docs.count()).select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole rows of df but for near duplicates: of each group the one with the smallest id.

    Where several rows of a group have that id, or none has an id, a hash of the whole row decides; of
    rows that are equal throughout one stays. Rows of different groups never replace one another,
    whatever their ids. Columns may be of any type and name. Only rows that go, rows that have a copy,
    and those few that a broadcast filter can't tell from them are shuffled with their texts.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    whole = [F.to_json(F.struct(*own), {"ignoreNullFields": "false"})]  # maps have no hash
    keys = {"k1": F.xxhash64(*whole), "k2": F.xxhash64(F.lit(1), *whole)}
    docs = materialize(fingerprints(df, id_col, text_col, carry=keys), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    # A minimum for each fingerprint first, with partial sums: copies, however many, meet the groups as one row.
    each = docs.groupBy("fp").agg(F.min(order).alias("least"))
    first = each.join(groups(docs), F.col("fp") == F.col("f")).groupBy("part").agg(F.min("least").alias("first"))
    kept = materialize(first.select(F.col("first.k1").alias("kept1"), F.col("first.k2").alias("kept2")).distinct(), "kept")
    each = docs.groupBy(F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(F.count("*").alias("rows"))
    suspects = each.join(kept, (F.col("h1") == F.col("kept1")) & (F.col("h2") == F.col("kept2")), "left").where("kept1 is null or rows > 1")
    rows = _filtered(df.select(F.struct(*own).alias("row"), keys["k1"].alias("h1"), keys["k2"].alias("h2")), materialize(suspects.select("h1"), "suspects"))
    some = rows.where("hit").join(kept, (F.col("h1") == F.col("kept1")) & (F.col("h2") == F.col("kept2")), "left_semi").dropDuplicates(["h1", "h2"])
    return rows.where("not hit").select("row.*").union(some.select("row.*"))
