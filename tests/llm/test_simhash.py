import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from seatloom.llm import lines, rules, simhash
from seatloom.llm.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius):
    """{fingerprint: least reachable} by comparing all pairs."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_rows_match_all_pairs(edges, edge_rows, nothing):
    fps = {r[1]: plain_fingerprint(r[1]) for r in edge_rows}
    groups, least = components(set(fps.values()), 4), {}
    for r in edge_rows:
        if r[0] is not None:
            g = groups[fps[r[1]]]
            least[g] = min(r[0], least.get(g, r[0]))
    for chunk in (8192, 2):
        got = simhash.near_duplicates(edges, chunk=chunk).collect()
        want = [(r[0], fps[r[1]], least.get(groups[fps[r[1]]])) for r in edge_rows]
        assert sorted(map(str, [(r.doc_id, r.fp % 2**64, r.component_id) for r in got])) == sorted(map(str, want))
    assert simhash.near_duplicates(nothing).count() == 0


def test_tiles_lose_no_link(spark):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1}
    for f in list(fps):
        for _ in range(r.randint(0, 6)):
            for _ in range(r.randint(1, 3)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    # a crowded bucket: all share the low block
    fps |= {(r.getrandbits(6) << 40) | 5 for _ in range(60)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    want = components(fps, 4)
    for chunk, blocks in ((10_000, None), (7, 5), (10_000, 6), (20, 8)):
        edges = simhash.links(df, 4, chunk, blocks).select((F.col("fp_a")).alias("a"), F.col("fp_b").alias("b")).collect()
        root = {f: f for f in fps}
        for e in edges:
            a, b = e.a % 2**64, e.b % 2**64
            assert (a ^ b).bit_count() <= 4
            root = {f: (root[a] if root[f] == root[b] else root[f]) for f in root}
        parts = lambda m: sorted(sorted(g) for g in {k: [f for f in m if m[f] == k] for k in set(m.values())}.values())
        assert parts(root) == parts(want)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 300: 300, 301: 300}


def test_tile_pairs_beyond_the_radius_are_skipped():
    r = random.Random(7)
    fps = np.array(sorted({r.getrandbits(64) for _ in range(700)} | {(1 << k) - 1 for k in range(1, 64)}), np.uint64)
    bits = np.sort(np.bitwise_count(fps)).astype(int)
    pairs, skipped = simhash.tile_pairs(bits, bits, 4, True, 16)
    cut = simhash.tiles(bits, 16)
    assert (np.diff(cut) <= 16).all() and all(len(set(bits[x:y])) == 1 for x, y in zip(cut, cut[1:]))
    assert skipped > cut.size and len(pairs) + skipped == (cut.size - 1) * cut.size // 2
    found = {tuple(sorted(x)) for i, j in simhash.linked(fps, fps, 4, True, 16) for x in zip(i.tolist(), j.tolist()) if x[0] != x[1]}
    assert found == {(i, j) for i, j in itertools.combinations(range(fps.size), 2) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    cross = {x for i, j in simhash.linked(fps[:200], fps[200:], 4, False, 16) for x in zip(i.tolist(), j.tolist())}
    assert cross == {(i, j - 200) for i, j in found if i < 200 <= j}


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.block_count(n, 4) for n in (0, 50_000, 100_000_000, 10**10, 10**12)] == [5, 5, 6, 7, 8]
    for blocks in (5, 6, 7, 8):
        masks = simhash.block_masks(blocks, 4)
        for gone in itertools.combinations(range(0, 64, 7), 4):  # any four bits leave one choice untouched
            assert any(not any(m >> g & 1 for g in gone) for m in masks)


def test_keep_one(edges, edge_rows, spark):
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    fps = {r[1]: plain_fingerprint(r[1]) for r in edge_rows}
    groups, want = components(set(fps.values()), 4), {}
    for r in edge_rows:
        g = groups[fps[r[1]]]
        want[g] = min(want.get(g, r), r, key=lambda x: (x[0] is None, x[0]))
    assert sorted(map(str, (tuple(r)[:2] for r in kept.collect()))) == sorted(str(r[:2]) for r in want.values())


def test_keep_one_of_rows_that_share_an_id(spark):
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five " * 9, "red green blue white black " * 9)
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (2, c, "x"), (3, a, "x"), (None, b, "x"), (None, "some words of no other text " * 4, None), (None, "some words of no other text " * 4, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k1 string")
    got = [(r.doc_id, r.text) for r in simhash.keep_one(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, a), (1, b), (2, c), (None, rows[6][1])]))
    ids = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(df).collect()}
    assert sorted(str(x) for x in ids.values()) == sorted(map(str, [1, 1, 2, 1, 1, None]))


def test_buckets_of_two_skip_pairs(spark):
    """On a small corpus buckets have a few fingerprints each; those whose counts differ by more than the radius aren't compared."""
    fps = [r.fp for r in simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("fp").distinct().collect()]
    values = np.array(fps, np.int64).view(np.uint64)
    compared = skipped = 0
    for mask in simhash.block_masks(simhash.block_count(values.size, 4), 4):
        keys = values & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        for bucket in np.split(values[order], np.nonzero(np.diff(keys[order]))[0] + 1):
            if bucket.size > 1:
                bits = np.sort(np.bitwise_count(bucket).astype(int))
                pairs, left = simhash.tile_pairs(bits, bits, 4, True)
                compared, skipped = compared + len(pairs), skipped + left
    assert skipped > 100 and compared > 100


def test_keep_one_takes_any_column(spark):
    rows = [(1, "a b c d e f g", {"k": 1}, 2.5), (2, "a b c d e f g", {"k": 2}, None), (2, "a b c d e f g", {"k": 2}, None), (3, "other words here that differ a lot", None, 1.0), (3, "other words here that differ a lot", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, props map<string, int>, `a.b` double")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.props, r["a.b"]) for r in kept.collect()) == [(1, {"k": 1}, 2.5), (3, None, 1.0)]


def test_line_dedup_and_rules_take_any_column(spark):
    text = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(1, text, {"k": 1}, 1), (2, text + "\nmore", {"k": 2}, 2)], "doc_id long, text string, props map<string, int>, `a.b` int")
    out = lines.dedup_lines(df)
    assert sorted((r.doc_id, r.text, r.props["k"], r["a.b"]) for r in out.collect()) == [(1, text, 1, 1), (2, "more", 2, 2)]
    named = df.withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    assert rules.keep_passing(named).columns == named.columns
