"""Phrases, byte-level BPE and hard negatives against plain versions, the library and SQL."""

import base64
import collections
import hashlib
import random
import re
import tracemalloc
from unittest.mock import MagicMock

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from seatloom.llm import bytepairs, negatives, phrases, queries

from .conftest import SF

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", ["op11_collocations", "op13_hard_negatives"])
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_matches_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    assert sorted(tuple(row[c] for c in columns) for row in queries.QUERIES[name](spark, sf).collect()) == want
    assert want or sf == SF


def plain_collocations(rows, least, top, longest=5):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {x for x, a in f.items() if a >= least and len(x[1]) > 1}
    inside = {(lang, p[i:j]) for lang, p in found for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[lang, p] >= f[lang, p[i:j]]}
    out = collections.defaultdict(list)
    for lang, p in found - inside:
        score, k = min((1000 * f[lang, p] * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -f[lang, p], " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, v in out.items() for r, x in enumerate(sorted(v)[:top], 1)}


def phrase_rows():
    r = random.Random(4)
    words, gaps = ["a", "B", "the", "ÉE", "日本", "x'y", "|", "\x1c"], [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", " ", "\r"]
    text = lambda: "".join(r.choice(words) + r.choice(gaps) for _ in range(r.randint(0, 60)))
    rows = [(r.choice(["en", "de", None, "und"]), r.choice([text(), text(), None, "the the the the the the"])) for _ in range(150)]
    return [*rows, rows[0], ("en", " ".join(["a b the"] * 900)), ("zz", "")]


@pytest.mark.parametrize("top", [2000, 5])
def test_collocations_like_counting(spark, top):
    rows = phrase_rows()
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "lang string, text string, n int, phrase string").repartition(3)
    want = plain_collocations(rows, 9, top)
    assert len(want) > 10
    assert {tuple(x) for x in phrases.collocations(df, least=9, top=top).collect()} == want


def all_pass():
    f = phrases.Filter(phrases.LEAST_BITS, [])
    f.octets[:] = 255
    return f


@pytest.mark.parametrize("k", [2, 3, 5])
def test_long_texts_are_counted_block_by_block(k):
    rows = [(lang or "und", text or "") for lang, text in phrase_rows()[:80]] + [("en", "x" * 200 + " a b c" * 40)]
    langs, texts = zip(*rows)

    def counts(block):
        found = np.concatenate(list(phrases.Words(block).grams(list(texts), list(langs), k, all_pass())))
        return collections.Counter(map(tuple, found.tolist()))

    whole = counts(1 << 20)
    assert whole == counts(64) == counts(7)
    pieces = [re.findall("[^ \t]+", p) for _, t in rows for p in re.split("[.,;:!?\n\x0b\x0c\r]", t)]
    assert whole.total() == sum(max(0, len(w) - k + 1) for w in pieces)


def test_tasks_that_pass_counts_on_early(spark):
    df = spark.createDataFrame(phrase_rows()[:60], "lang string, text string").na.fill("", ["lang", "text"]).repartition(2)
    counts = [{tuple(x.key): x.f for x in phrases.count_grams(df, 3, all_pass(), 1, most).collect()} for most in (5, phrases.HELD)]
    assert counts[0] == counts[1] and len(counts[0]) > 100


def test_a_task_takes_little_more_memory_than_it_counts(spark):
    """What a counting task holds at once over 1.5 million different pairs of 24 bytes, and what it passes on."""
    r = np.random.default_rng(5)
    texts = [" ".join(map(str, r.integers(0, 40_000, 300).tolist())) for _ in range(5000)]
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"] * 500, "text": texts[a : a + 500]}) for a in range(0, 5000, 500)]
    docs = MagicMock()
    docs.sparkSession.sparkContext.broadcast.return_value.value = all_pass()
    docs.sparkSession.conf.get.return_value = "51"
    phrases.count_grams(docs, 2, docs.sparkSession.sparkContext.broadcast().value, 100)
    run = docs.select.return_value.mapInArrow.call_args.args[0]
    different = occurrences = 0
    tracemalloc.start()
    for batch in run(iter(batches)):
        for block in batch.column(1):
            rows = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, 3)
            different, occurrences = different + len(rows), occurrences + int(rows[:, 2].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert occurrences == 299 * 5000 and different > 1_400_000
    assert peak < 120e6


def test_filter_tells_frequent_phrases():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, (5000, 2), np.uint64)
    own = phrases.gram_hashes(keys) & np.uint64((1 << 20) - 1)
    bits = np.zeros(1 << 17, np.uint8)
    np.bitwise_or.at(bits, own >> np.uint64(3), (1 << (own & np.uint64(7))).astype(np.uint8))
    f = phrases.Filter(20, [(1 + k, bits[k * 4096 : (k + 1) * 4096].tobytes()) for k in range(32)])
    assert f(phrases.gram_hashes(keys)).all()
    assert f(phrases.gram_hashes(keys[:, ::-1])).mean() < 0.05


def test_driver_takes_the_filter_in_pieces(spark, monkeypatch):
    """The driver holds little more than the filter itself, and the number of jobs follows from its size, not from the partitions."""
    monkeypatch.setattr(phrases, "LEAST_BITS", 27)
    count = 200_000
    grams = spark.range(count).select(F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1))).alias("key"))
    was = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for coalesced, group in (("true", "filter-whole"), ("false", "filter-dealt")):
            spark.conf.set("spark.sql.shuffle.partitions", "40")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
            spark.sparkContext.setJobGroup(group, group)
            tracemalloc.start()
            f = phrases.frequent_filter(grams, count)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert f.octets.size == 1 << 24 and peak < 1.6 * f.octets.size
            assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 12
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for c, x in was.items():
            spark.conf.set(c, x)
    keys = np.array([x.key for x in grams.where("id % 100 = 0").collect()], np.int64).view(np.uint64)
    assert f(phrases.gram_hashes(keys)).all() and np.unpackbits(f.octets).sum() <= count


def test_filters_go_once_their_level_is_written(spark, monkeypatch):
    made, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: made.append(broadcast(self, x)) or made[-1])
    _, grams = phrases.phrase_levels(spark.createDataFrame([("en", "a b c d e f. " * 20)], "lang string, text string"), 10, 5)
    assert grams.groupBy(F.size("key")).count().count() == 5
    assert len(made) == 4 and not any(x._jbroadcast.isValid() for x in made)


def test_collocations_of_nothing(spark, nothing, edges):
    assert phrases.collocations(nothing).count() == 0
    assert phrases.collocations(edges).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    with pytest.raises(ValueError):
        phrases.collocations(nothing, share=90)


# Byte-level BPE


@pytest.fixture(scope="module")
def model():
    return bytepairs.load(queries.BYTE_RANKS)


@pytest.fixture(scope="module")
def library():
    with open(queries.BYTE_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward_texts(n):
    r = random.Random(5)
    parts = ["a", "b", "'", "'s", "re", "ll", "'ve", " ", "  ", "\n", "\t", "1", "23", "é", "日", "!", " ", "😀", "\0", "T", "don't", "́", "\r\n", "a" * 30, "\x1c", "\u0085", " ", "<|endoftext|>"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 300))) for _ in range(n)]


def test_every_character_like_the_library(model, library):
    codes = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x33000), *range(0xE0000, 0xE0200), 0x10FFFF]]
    texts = ["".join(f"x{c}y {c}{c}1{c} !{c}\n{c}'s" for c in codes[k : k + 50]) for k in range(0, len(codes), 50)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_texts_like_the_library(model, library):
    r = random.Random(6)
    texts = [*awkward_texts(1500), "a" * 5000, "ab" * 3000, "".join(r.choice("abcdefgh") for _ in range(4000)), "\n" * 3000, " " * 3000 + "x", "", " "]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert model.decode(np.frombuffer(ids, "<u4")) == text.encode()


@pytest.mark.parametrize("size", [1, 2, 5, 16, 50])
def test_chunks_meet(model, library, size):
    for text in [*awkward_texts(300), "a" * 300, "x" + " " * 90 + "y", "''''" * 20]:
        parts = bytepairs.chunks(text, model.kinds, size)
        assert [p[3] for p in parts] == [text[p[0] : p[0] + len(p[3])] for p in parts]
        ids = bytepairs.stitched([model.encode_chunk(p[3], p[0], p[1], p[2]) for p in parts])
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_known_words_are_replaced_when_full(model, library, monkeypatch):
    monkeypatch.setattr(model, "known", bytepairs.KnownWords(64))
    texts = awkward_texts(40)
    for text in texts:
        assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("chunk", [8, bytepairs.CHUNK])
def test_encode_texts(spark, edges, edge_rows, library, chunk):
    rows = bytepairs.encode_texts(edges.repartition(3), queries.BYTE_RANKS, digests=True, chunk=chunk).collect()
    want = []
    for row in edge_rows:
        text = row[1] or ""
        ids = np.array(library.encode_ordinary(text), "<u4")
        want.append((row[0], ids.size, hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_encode_texts_whole_results(spark, edges, edge_rows, library, nothing):
    rows = bytepairs.encode_texts(edges, queries.BYTE_RANKS, chunk=100).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(repr((x[0], library.encode_ordinary(x[1] or ""), x[1] or "")) for x in edge_rows)
    assert bytepairs.encode_texts(nothing, queries.BYTE_RANKS).count() == 0


# Hard negatives


def plain_negatives(rows, every):
    rows = [x for x in rows if None not in x and None not in x[2]]
    anchors = {}
    for i, label, v in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-dot(v, x), i, own) for i, own, x in rows)
        for p, ps in [(i, -s) for s, i, own in scored if own == label and i != a][:5]:
            fit = [(i, -s) for s, i, own in scored if own != label and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, k, n, ps, ns) for k, (n, ns) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("few", [4, 0])
def test_negatives_like_sorting(spark, monkeypatch, few):
    """A vector that a third of all rows share, ids far apart, and every bucket cut down to single ids (few = 0)."""
    monkeypatch.setattr(negatives, "FEW", few)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 16)
    r = random.Random(2)
    hot = [r.randint(-9, 30) for _ in range(6)]
    rows = [(i, r.randint(0, 2), hot if r.random() < 0.4 else [r.randint(-60, 90) for _ in range(6)]) for i in range(400)]
    rows += [(10**9 + i, 1, hot) for i in range(150)] + [(-20, 1, hot), (None, 1, hot), (40, None, hot), (41, 1, None), (42, 1, [1, None]), (43, 2, []), (44, 2, [200]), (60, 9, [7] * 9)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, label long, vector array<long>, score string").repartition(3)
    want = plain_negatives(rows, 20)
    assert len(want) > 100
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 20 == 0).collect())) == want


def test_negatives_of_few_rows(spark):
    schema = "vec_id long, label long, vector array<long>"
    assert negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 2 == 0).count() == 0
    rows = [(0, 1, [3, 0]), (1, 1, [2, 5]), (2, 2, [1, 9]), (3, 2, [-4, 0]), (5, 1, [0, 1])]
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") == 0).collect())) == plain_negatives(rows, 7)


def test_inner_products_are_exact():
    r = np.random.default_rng(3)
    for most in (100, 1 << 28):
        a, b = r.integers(-most, most, (5, 7)), r.integers(-most, most, (6, 7))
        assert negatives.inner_products(a, b).tolist() == [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a]
    with pytest.raises(OverflowError):
        negatives.inner_products(np.array([[1 << 40]]), np.array([[1 << 40]]))
