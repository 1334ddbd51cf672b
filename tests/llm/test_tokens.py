import collections
import hashlib
import random
import zlib

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seatloom.llm import packing, pieces
from seatloom.llm.queries import PIECE_MODEL as PIECES
from seatloom.llm.queries import WORD_VOCABULARY as WORDS

ALPHABET = list("abcdeinorst THE.,'!0123\n\t") + ["  ", "▁", "é", "É", "ß", "日", "́", "😀", "İ", "<s>", "<|endoftext|>", "'s", "'ll", " ", "\x1c"]
text = st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join)


@given(text)
@settings(max_examples=300, deadline=None)
def test_pieces_are_the_librarys(x):
    model = pieces.load(PIECES)
    ids = np.frombuffer(model.encode([x])[0], "<u4").tolist()
    assert ids == model.library.encode(x)
    full = [1, *ids, 2]
    assert model.decode(np.array(full)).decode() == model.library.decode(full)


def test_long_words_and_any_ids():
    model, r = pieces.load(PIECES), random.Random(1)
    for x in ("ab" * 2000, " " * 333, "".join(r.choice("abcdeinthrs") for _ in range(5000)), "".join(r.choice("▁ ath") for _ in range(3000))):
        assert np.frombuffer(model.encode([x])[0], "<u4").tolist() == model.library.encode(x)
    for _ in range(500):
        ids = [r.randrange(32000) for _ in range(r.randint(0, 10))]
        assert model.decode(np.array(ids, int)).decode() == model.library.decode(ids)


def test_encode_rows(edges, edge_rows, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for row in edge_rows:
        ids = library.encode(row[1] or "", add_bos=True, add_eos=True)
        want.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = pieces.encode_texts(edges, PIECES, digests=True).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sorted(len(r.ids) for r in pieces.encode_texts(edges, PIECES).collect()) == sorted(w[1] for w in want)
    assert pieces.encode_texts(nothing, PIECES).count() == 0


@given(text)
@settings(max_examples=300, deadline=None)
def test_words_are_the_librarys(x):
    model = packing.load(WORDS)
    assert np.frombuffer(model.encode([x])[0], "<u4").tolist() == model.library.encode(x, add_special_tokens=False).ids


plain = st.lists(st.sampled_from([*"aesrtvlmdDLÉß09.,'!-#\n\t ", "'s", "'ll", "'re ", "''", " ", "word "]), max_size=60).map("".join)


@given(st.lists(plain, max_size=6))
@settings(max_examples=300, deadline=None)
def test_plain_texts_are_the_librarys(xs):
    model = packing.load(WORDS)
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(xs)] == [model.library.encode(x, add_special_tokens=False).ids for x in xs]


def test_long_texts_and_full_tables(monkeypatch):
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeiourstlnm'") for _ in range(r.randint(1, 9)))
    texts = [" ".join(word() for _ in range(4000)) for _ in range(4)] + ["ab" * 3000 + " " + "ab" * 2999, "", "x" * 9000]
    model = packing.WordTokenizer(WORDS)
    want = [model._encode_whole(x) for x in texts]
    assert model.encode(texts) == want
    monkeypatch.setattr(packing, "BLOCK", 2000)  # the long word is longer than two blocks
    assert model.encode(texts) == want
    model.known = packing.KnownWords(1500)  # emptied again and again
    assert model.encode(texts) == want and model.known.count <= 1500


def test_every_id_is_packed_once(edges, edge_rows, nothing):
    library = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(edges, WORDS, with_ids=True, most=256).collect()
    want = collections.Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in edge_rows)
    pieces_of, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces_of[r.doc_id].append((r.start, tuple(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for key in {r[0] for r in edge_rows}:
        have = collections.Counter(pieces_of[key])
        for (doc, ids), n in want.items():
            if doc == key:
                for at in range(0, len(ids), 256):
                    have[at, ids[at : at + 256], len(ids)] -= n
        assert not any(have.values())
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(nothing, WORDS).count() == 0


def test_ties_are_placed_alike_in_any_order(spark):
    """Pieces of one id and start, as repeated or missing ids give them, have the same places however the rows come."""
    r = random.Random(8)
    rows = [(r.choice([None, 7]), 0, r.randint(1, 16), r.randint(0, 3), 5) for _ in range(2500)]
    df = lambda x: spark.createDataFrame(x, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    first = sorted(map(str, packing.pack(df(rows), 64).collect()))
    r.shuffle(rows)
    assert len(first) == 2500 and sorted(map(str, packing.pack(df(rows).repartition(7), 64).collect())) == first


def test_patterns_near_the_bound():
    rng = np.random.default_rng(4)
    for sizes, demand in ((np.arange(1, 129), rng.integers(0, 400, 128)), (np.array([50]), np.array([7])), (np.array([43, 44, 64, 128]), np.array([3, 5, 2, 1]))):
        on = demand > 0
        sizes, demand = sizes[on], demand[on]
        used = packing.cutting_stock(sizes, demand.astype(float), 128)
        assert all(p @ sizes <= 128 for p, _ in used) and (sum(p * n for p, n in used) >= demand).all()
        assert sum(n for _, n in used) <= max(-(-int(sizes @ demand) // 128) * 1.03 + 3, sum(-(-d // (128 // s)) for s, d in zip(sizes, demand)))
    assert packing.cutting_stock(np.array([], int), np.array([]), 128) == []
    value, pattern = packing.best_pattern(np.array([0.4, 0.55]), np.array([3, 4]), 10)
    assert abs(value - 1.35) < 1e-9 and pattern.tolist() == [2, 1]
