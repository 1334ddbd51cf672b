"""Operator 12, byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut in chunks that overlap. Chunks are dealt out and pre-tokenised on their own, so a
chunk may begin inside a word. Two neighbours are stitched at the first place in their overlap at
which both have a pre-token boundary: what a match is depends on the text from there on only, so
from then on they agree. An overlap runs on to the first place that is a boundary wherever one began
to read (after a run of letters or numbers, or before white space), so neighbours always meet. Pieces
are then encoded by ranks, each different one once a worker. Decoding concatenates raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow
from .packing import KnownWords, WordHashes
from .pieces import NONE, Pieces

#: Characters from one chunk's begin to the next one's.
CHUNK = 1 << 15
#: Characters that are cut in words at once.
BLOCK = 1 << 18
#: Longer pieces, in bytes, are merged one by one.
LONG_PIECE = 256
#: A match that ends so many characters before the end of what was read doesn't depend on what follows.
LOOK_AHEAD = 3

_LETTER, _NUMBER, _OTHER, _SPACE, _END = range(5)
#: The pattern's classes of characters.
_CLASSES = {_LETTER: r"\p{L}+", _NUMBER: r"\p{N}+", _SPACE: r"\s+"}
_ENDINGS = {1: tuple(b"stmd"), 2: (b"re", b"ve", b"ll")}


def character_kinds() -> np.ndarray:
    """Letter, number, white space or other, by code point, as tiktoken's own version of Unicode has it."""
    every = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32).tobytes().decode("utf-32-le")
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in _CLASSES.items():
        alike = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
        found = bytes(alike.encode_ordinary(every)).decode()  # what doesn't match is left out
        kinds[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return kinds


def boundaries(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Does a match of the pattern begin here? For all characters at once; kind is _END at the end of each text.

    A match is a run of one kind with the plain space before it, if there is one. Of white space before
    anything else the last character stands alone, or goes with what follows if it is a plain space. An
    apostrophe that begins a match is one with an ending s, t, m, d, re, ve or ll that follows at once.
    """
    begins = np.ones(codes.size, bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _END)
    last = np.nonzero((kind[:-1] == _SPACE) & (kind[1:] < _SPACE))[0]
    begins[last] = True
    begins[last[codes[last] == 32] + 1] = False
    marks = np.nonzero((codes[:-1] == 39) & begins[:-1] & (kind[1:] == _LETTER))[0]
    if marks.size:
        one, two = codes[marks + 1], codes[marks + 2]
        length = np.select([np.isin(one, _ENDINGS[1]), np.any([(one == a) & (two == b) for a, b in _ENDINGS[2]], axis=0)], [1, 2], 0)
        marks, length = marks[length > 0], length[length > 0]
        begins[marks + 1] = False
        begins[marks + 1 + length] = True
    return begins


class BytePairs(Pieces):
    """A vocabulary of byte strings by rank. The merge rounds are those of Pieces, over bytes instead of characters."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if any(bytes([k]) not in self.ranks for k in range(256)):
            raise ValueError("a vocabulary without all single bytes")
        self.size = max(self.ranks.values()) + 1
        self.of_char = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        pairs = {}
        for word, rank in self.ranks.items():
            for cut in range(1, len(word)):
                a, b = self.ranks.get(word[:cut]), self.ranks.get(word[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = self.into = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        blocks = [b""] * self.size
        for word, rank in self.ranks.items():
            blocks[rank] = word
        self.block_size = np.array(list(map(len, blocks)), np.int64)
        self.block_at = np.cumsum(self.block_size) - self.block_size
        self.block = np.frombuffer(b"".join(blocks), np.uint8)
        self.kinds = character_kinds()
        self.hashes, self.known = WordHashes(2 * BLOCK), KnownWords()

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one piece. The pair of least rank, leftmost first, is taken from a heap."""
        ids = [self.ranks[piece[k : k + 1]] for k in range(len(piece))]
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        text = [piece[k : k + 1] for k in range(len(piece))]
        waiting = [(rank, k, text[k] + text[k + 1]) for k in range(len(ids) - 1) if (rank := self.ranks.get(text[k] + text[k + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            rank, k, both = heapq.heappop(waiting)
            right = after[k] if ids[k] >= 0 else -1
            if right < 0 or text[k] + text[right] != both:
                continue
            ids[k], text[k], ids[right] = rank, both, -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0:
                    both = text[left] + text[after[left]]
                    if (rank := self.ranks.get(both)) is not None:
                        heapq.heappush(waiting, (rank, left, both))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces as little-endian unsigned 32-bit integers: a piece of the vocabulary is one id, others are merged."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[k] = np.array(self.merge_long(piece), "<u4").tobytes()
            else:
                short.append(k)
        for at in range(0, len(short), 50_000):
            part = short[at : at + 50_000]
            for k, ids in zip(part, self.merge_words([pieces[k].decode("latin-1") for k in part]), strict=True):
                out[k] = ids
        return out

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, upto, starts, limits) of texts taken together, each with one mark at its end.

        ids come one after another; piece t begins at character starts[t] and its ids end at upto[t + 1];
        text k has pieces limits[k] to limits[k + 1] - 1.
        """
        whole = "\0".join(texts) + "\0"
        codes, octets = np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.frombuffer(whole.encode(), np.uint8)
        lasts = np.cumsum([len(x) + 1 for x in texts]) - 1
        kind = self.kinds[codes]
        kind[lasts] = _END
        places = np.nonzero(boundaries(codes, kind))[0]
        ends, real = np.append(places[1:], codes.size), kind[places] != _END
        starts, ends = places[real], ends[real]
        first, last = starts, ends
        if octets.size > codes.size:
            at = np.r_[0, np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))]
            first, last = at[starts], at[ends]
        hashes = (self.hashes if octets.size <= 2 * BLOCK else WordHashes(octets.size))(octets, first, last)
        numbers = self.known.find(hashes)
        if (numbers < 0).any():
            late = np.nonzero(numbers < 0)[0]
            new, one = np.unique(hashes[late], return_index=True)
            if self.known.count + new.size > self.known.most:
                self.known = KnownWords(max(self.known.most, hashes.size))
                late = np.arange(hashes.size)
                new, one = np.unique(hashes, return_index=True)
            found = [octets[a:b].tobytes() for a, b in zip(first[late[one]].tolist(), last[late[one]].tolist(), strict=True)]
            self.known.add(new, self.encode_pieces(found))
            numbers[late] = self.known.find(hashes[late])
        ids, upto = self.known.ids_of(numbers)
        return ids, np.append(0, upto), starts, np.searchsorted(starts, np.append(0, lasts + 1))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers, some texts at a time."""
        out: list[bytes] = []
        block, size = [], 0
        for text in [*texts, None]:
            if block and (text is None or size + len(text) > BLOCK // 2):
                ids, upto, _, limits = self.tokens(block)
                flat, at = ids.astype("<u4").tobytes(), (upto[limits] * 4).tolist()
                out += [flat[a:b] for a, b in zip(at, at[1:])]
                block, size = [], 0
            if text is not None:
                block.append(text)
                size += len(text) + 1
        return out

    def encode_chunk(self, text: str, start: int, shared: int, following: int) -> tuple[bytes, list[tuple[int, int]], list[tuple[int, int]]]:
        """(ids, head, tail) of a chunk that begins at character start of its text.

        head: (place, ids before it) of the boundaries among its first shared characters, which the chunk
        before has read too. tail: the same from place following on, where the next chunk begins
        (negative for the last one), without the boundaries that text not read here might move.
        """
        ids, upto, starts, _ = self.tokens([text])
        meet = lambda keep: list(zip((starts[keep] + start).tolist(), upto[keep].tolist()))
        head = meet(np.nonzero(starts < shared)[0])
        if following < 0:
            return ids.astype("<u4").tobytes(), head, []
        return ids.astype("<u4").tobytes(), head, meet(np.nonzero((starts >= following - start) & (starts <= len(text) - LOOK_AHEAD))[0])

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes of ids, one after another."""
        ids = np.asarray(ids, np.int64)
        sizes = self.block_size[ids]
        ends = np.cumsum(sizes)
        return self.block[np.repeat(self.block_at[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if ends.size else 0)].tobytes()


def chunks(text: str, kinds: np.ndarray, size: int = CHUNK) -> list[tuple[int, int, int, str]]:
    """(start, shared, following, text) of a text's chunks: where each begins, how many of its characters the one before has read, where the next begins (-1 for the last).

    A chunk begins at every multiple of size, but for those inside an overlap that had to run on.
    """
    kind = kinds[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    here, then = kind[:-1], kind[1:]
    sure = np.nonzero((here != then) & ((here <= _NUMBER) | ((then == _SPACE) & (here != _SPACE))))[0] + 1
    out, at, read = [], 0, 0
    while True:
        k = np.searchsorted(sure, at + size, side="right")
        meet = int(sure[k]) if at + size < len(text) and k < sure.size else len(text)
        end = min(meet + LOOK_AHEAD, len(text))
        following = meet // size * size if end < len(text) else -1
        out.append((at, max(0, read - at), following, text[at:end]))
        if following < 0:
            return out
        at, read = following, end


def stitched(parts: list[tuple[bytes, list[tuple[int, int]], list[tuple[int, int]]]]) -> bytes:
    """The ids of a text from those of its chunks in order, (ids, head, tail) each."""
    out, begin = [], 0
    for (ids, _, tail), following in zip(parts, [*parts[1:], None]):
        if following is None:
            out.append(ids[4 * begin :])
            break
        head = dict(following[1])
        place, end = next((x for x in tail if x[0] in head))
        out.append(ids[4 * begin : 4 * end])
        begin = head[place]
    return b"".join(out)


_loaded: dict[str, BytePairs] = {}


def load(path: str) -> BytePairs:
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]


def _results(model: BytePairs, found: list[bytes], digests: bool) -> dict:
    arrays = [np.frombuffer(x, "<u4") for x in found]
    texts = [model.decode(x) for x in arrays]
    if digests:
        return {"n_tokens": [x.size for x in arrays], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in found], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in texts]}
    offsets = np.cumsum([0, *(x.size for x in arrays)])
    return {"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int32))), "decoded": [x.decode(errors="replace") for x in texts]}


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Encode and decode every whole text: (doc_id, ids, decoded), or with digests (doc_id, n_tokens, ids_sha256, decoded_sha256).

    One row per input row, whatever its id; a null text is encoded as the empty one. Texts of up to
    chunk characters are encoded where they are. Longer ones are cut in chunks, which are dealt out
    over the cluster; equal chunks of rows with one id and text are encoded once. No special token is
    recognised. path must be readable on every executor.
    """
    result = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    rows = df.select(column(df, id_col, "doc_id", "long"), F.coalesce(column(df, text_col, "text", "string"), F.lit("")).alias("text"))

    def whole():
        model = load(path)
        return lambda part: {"doc_id": part.column(0)} | _results(model, model.encode(part.column(1).to_pylist()), digests)

    def cut():
        kinds = load(path).kinds

        def run(part: pa.RecordBatch) -> dict:
            found = [(k, n, *x) for k, text in enumerate(part.column(3).to_pylist()) for n, x in enumerate(chunks(text, kinds, chunk))]
            owner = pa.array([x[0] for x in found], pa.int64())
            return {name: part.column(i).take(owner) for i, name in enumerate(("doc_id", "h1", "h2"))} | {name: [x[1 + i] for x in found] for i, name in enumerate(("k", "start", "shared", "following", "text"))}

        return run

    def encode():
        model = load(path)

        def run(part: pa.RecordBatch) -> dict:
            start, shared, following, text = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("start", "shared", "following", "text"))
            found = [model.encode_chunk(*x) for x in zip(text, start, shared, following, strict=True)]
            pair = lambda x: [{"place": a, "before": b} for a, b in x]
            return {name: part.column(i) for i, name in enumerate(("doc_id", "h1", "h2", "k", "n"))} | {"ids": [x[0] for x in found], "head": [pair(x[1]) for x in found], "tail": [pair(x[2]) for x in found]}

        return run

    def join():
        model = load(path)
        points = lambda x: [(p["place"], p["before"]) for p in x]

        def run(part: pa.RecordBatch) -> dict:
            found = [stitched([(x["ids"], points(x["head"]), points(x["tail"])) for x in parts]) for parts in part.column(2).to_pylist()]
            return {"doc_id": part.column(0), "n": part.column(1)} | _results(model, found, digests)

        return run

    short = map_arrow(rows.where(F.length("text") <= chunk), whole, f"doc_id long, {result}")
    long = rows.where(F.length("text") > chunk).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    dealt = map_arrow(long, cut, "doc_id long, h1 long, h2 long, k long, start long, shared long, following long, text string")
    own = ["doc_id", "h1", "h2"]
    dealt = dealt.groupBy(*own, "k").agg(F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in ("start", "shared", "following", "text")))
    point = "array<struct<place: bigint, before: bigint>>"
    found = map_arrow(dealt, encode, f"doc_id long, h1 long, h2 long, k long, n long, ids binary, head {point}, tail {point}")
    gathered = found.groupBy(*own).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "ids", "head", "tail"))).alias("parts"))
    joined = map_arrow(gathered.select("doc_id", "n", "parts"), join, f"doc_id long, n long, {result}")
    again = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n", "copy")
    return short.unionByName(again)
