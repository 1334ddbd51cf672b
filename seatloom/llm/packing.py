"""Operator 7, packing: token sequences filled by cutting-stock column generation.

Documents are tokenised and cut at multiples of the sequence length. The histogram of the lengths
left, at most a few hundred counts whatever the input, goes to the driver. There a linear program
over cutting patterns is solved by the revised simplex method, knapsack dynamic programming pricing
its columns; patterns are rounded down and what they leave is filled greedily. Pieces, ranked within
their length, are then assigned to the patterns' slots by joins.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, keep, local_rows, map_arrow, materialize

SEQUENCE_TOKENS = 2048
#: Lengths are rounded up to multiples of this for the linear program.
GRAIN = 8
END_ID = 1
#: Different words that a worker knows the ids of, and characters that it cuts at once.
KNOWN_WORDS, BLOCK = 1 << 19, 1 << 18
#: Pieces that are ranked in one window, about.
RANKED_ROWS = 500

# Texts of these characters only are cut in words here; NFC leaves them alone, and in lower case, one to one, they are Latin-1.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KINDS = np.array([_SPACE if c in b"\t\n\r " else _LETTER if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA) else _DIGIT if 48 <= c < 58 else _OTHER for c in range(256)], np.uint8)
_ENDINGS = {1: tuple(b"stmd"), 2: (b"re", b"ve", b"ll")}


def cut_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokenizer's words in lower-cased Latin-1 text that ends with white space.

    A word is a run of letters, a digit, or a run of other marks; but an apostrophe that begins such a
    run and is followed at once by one of the endings s, t, m, d, re, ve, ll is a word together with it.
    """
    kind = _KINDS[codes]
    begins = np.empty(codes.size, bool)
    begins[:1] = True
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    marks = np.nonzero((codes[:-2] == 39) & begins[:-2] & (kind[1:-1] == _LETTER))[0]
    if marks.size:
        one, two = codes[marks + 1], codes[marks + 2]
        length = np.select([np.isin(one, _ENDINGS[1]), np.any([(one == a) & (two == b) for a, b in _ENDINGS[2]], axis=0)], [1, 2], 0)
        marks, length = marks[length > 0], length[length > 0]
        begins[marks + 1] = False
        begins[marks + 1 + length] = True
    places = np.nonzero(begins)[0]
    ends = np.append(places[1:], codes.size)
    words = kind[places] != _SPACE
    return places[words], ends[words]


class WordHashes:
    """64-bit hashes of words: random values of their bytes in a polynomial over an odd random base, whose prefix sums give any word at once."""

    def __init__(self, most: int):
        rng = np.random.default_rng(2048)
        self.value = rng.integers(1, 1 << 63, 256, np.uint64)
        base = int(rng.integers(1 << 62, 1 << 63)) | 1
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(most, base, np.uint64)])
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(most, pow(base, -1, 1 << 64), np.uint64)])

    def __call__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.zeros(codes.size + 1, np.uint64)
        np.cumsum(self.value[codes] * self.power[: codes.size], out=total[1:])
        found = (total[ends] - total[starts]) * self.back[starts]
        found = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        for k in np.nonzero(ends - starts > 64)[0]:  # a polynomial is weak on long words
            found[k] = xxhash.xxh64_intdigest(codes[starts[k] : ends[k]].tobytes())
        return np.maximum(found, 1)


class KnownWords:
    """Ids of words by their hashes, in an open table of numpy arrays. Emptied when it is full."""

    def __init__(self, most: int = KNOWN_WORDS):
        self.most, self.bits = most, (2 * most - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.key, self.number = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.ids, self.start, self.size, self.count, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash's word, -1 where it isn't known."""
        out, slot, left = np.full(hashes.size, -1, np.int64), (hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(hashes.size)
        while left.size:
            key = self.key[slot[left]]
            same = key == hashes[left]
            out[left[same]] = self.number[slot[left[same]]]
            left = left[~same & (key != 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """New words, each hash once."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        count, used = self.count + len(ids), self.used + flat.size
        for name, least in (("ids", used), ("start", count), ("size", count)):
            held = getattr(self, name)
            if held.size < least:
                setattr(self, name, np.resize(held, 2 * least))
        self.ids[self.used : used] = flat
        self.size[self.count : count] = sizes
        self.start[self.count : count] = self.used + np.cumsum(sizes) - sizes
        numbers, slot, left = np.arange(self.count, count, dtype=np.int32), (hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(hashes.size)
        while left.size:
            free = left[self.key[slot[left]] == 0]
            self.key[slot[free]] = hashes[free]  # of several in one slot the last stays
            mine = self.key[slot[left]] == hashes[left]
            self.number[slot[left[mine]]] = numbers[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.count, self.used = count, used

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and where each word's end."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if ends.size else 0)], ends


class WordTokenizer:
    """word_bpe_49k.json by the tokenizers library, which sees each different word once."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.hashes, self.known = WordHashes(2 * BLOCK), KnownWords()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokenizer words. Many are encoded as one text; each ends with the only id that ends a word."""
        out: list[bytes] = []
        lines = [words[at : at + 200] for at in range(0, len(words), 200)]
        for line, found in zip(lines, self.library.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.nonzero(self.last[ids])[0] + 1
            if ends.size == len(line) and (not ends.size or ends[-1] == ids.size):
                flat = ids.tobytes()
                out += [flat[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            else:
                out += [self._encode_whole(x) for x in line]
        return out

    def _encode_whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts as little-endian unsigned 32-bit integers."""
        out, parts = [b""] * len(texts), []
        for k, text in enumerate(texts):
            if _PLAIN(text) and not any(s in text for s in _SPECIAL):
                parts += [(k, x) for x in self._blocks(text)]
            else:
                out[k] = self._encode_by_space(text)
        block, size = [], 0
        for part in [*parts, None]:
            if block and (part is None or size + len(part[1]) > BLOCK):
                for (k, _), ids in zip(block, self._encode_block([x for _, x in block]), strict=True):
                    out[k] += ids
                block, size = [], 0
            if part:
                block.append(part)
                size += len(part[1]) + 1
        return out

    def _blocks(self, text: str) -> list[str]:
        """A plain text in parts of at most BLOCK characters, cut at white space; a longer word is a part of its own."""
        if len(text) <= BLOCK:
            return [text]
        parts, at = [], 0
        for word in re.finditer(r"\s+", text):
            if word.end() - at > BLOCK // 2:
                parts.append(text[at : word.end()])
                at = word.end()
        return [*parts, text[at:]]

    def _encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: words are cut, hashed and looked up for all at once."""
        if sum(map(len, texts)) + len(texts) > 2 * BLOCK:
            return list(map(self._encode_whole, texts))
        codes = np.frombuffer(("\n".join(texts) + "\n").lower().encode("latin-1"), np.uint8)
        starts, ends = cut_words(codes)
        hashes = self.hashes(codes, starts, ends)
        numbers = self.known.find(hashes)
        if (numbers < 0).any():
            late = np.nonzero(numbers < 0)[0]
            new, first = np.unique(hashes[late], return_index=True)
            if self.known.count + new.size > self.known.most:
                self.known.clear()
                late = np.arange(hashes.size)
                new, first = np.unique(hashes, return_index=True)
            words = [codes[a:b].tobytes().decode("latin-1") for a, b in zip(starts[late[first]].tolist(), ends[late[first]].tolist(), strict=True)]
            self.known.add(new, self._encode_words(words))
            numbers[late] = self.known.find(hashes[late])
        ids, upto = self.known.ids_of(numbers)
        limits = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts]))
        flat, at = ids.astype("<u4").tobytes(), np.append(0, upto)[limits] * 4
        return [flat[a:b] for a, b in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)]

    def _encode_by_space(self, text: str) -> bytes:
        """Any text. No word of the pre-tokenizer crosses a space or line feed, so different parts between them are encoded once each."""
        if any(s in text for s in _SPECIAL):
            return self._encode_whole(text)
        parts = text.replace("\n", " ").split(" ")
        once = list(set(parts))
        found = dict(zip(once, (np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(once, add_special_tokens=False)), strict=True))
        return b"".join([found[x] for x in parts])


def load(path: str) -> WordTokenizer:
    return keep(__name__, path, lambda: WordTokenizer(path))


def token_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and the end id, cut at multiples of most."""

    def make():
        model, end = load(path), np.array([end_id], "<u4").tobytes()

        def run(part: pa.RecordBatch) -> dict:
            owners, starts, lengths, sums, totals, kept = [], [], [], [], [], []
            for k, ids in enumerate(model.encode([x or "" for x in part.column(1).to_pylist()])):
                ids += end
                for at in range(0, len(ids), 4 * most):
                    piece = ids[at : at + 4 * most]
                    owners.append(k)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(len(ids) // 4)
                    if with_ids:
                        kept.append(np.frombuffer(piece, "<i4"))
            out = {"doc_id": part.column(0).take(pa.array(owners, pa.int64())), "start": starts, "length": lengths, "ids_crc32": sums, "doc_tokens": totals}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(np.concatenate(kept)))
            return out

        return run

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return map_arrow(df.select(column(df, id_col, "doc_id", "long"), column(df, text_col, "text", "string")), make, schema)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the capacity: the best value, and how often each size is taken."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        fits = np.searchsorted(sizes, c, side="right")
        if fits:
            gains = prices[:fits] + value[c - sizes[:fits]]
            k = int(gains.argmax())
            if gains[k] > value[c]:
                value[c], choice[c] = gains[k], k
    pattern, c = np.zeros(sizes.size), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return value[capacity], pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that together they have a slot for every demanded item.

    sizes: ascending integers from 1 to capacity. The linear program min sum(x), A x >= demand starts
    from one pattern for each size; columns come from best_pattern() at the current dual prices until
    none improves, or the value is within a share of gap of the lower bound value / best price. Demands
    are set apart by tiny amounts, so that steps aren't degenerate. rounds is a guard: any basis is a
    valid packing.
    """
    m = sizes.size
    if not m:
        return []
    columns = np.diag((capacity // sizes).astype(float))
    cost, inverse = np.ones(m), np.diag(1 / np.diag(columns))
    stock = demand + 1e-3 * (1 + np.arange(m) % 97 / 97)
    x = inverse.diagonal() * stock
    for _ in range(rounds):
        prices = np.einsum('i,ij->j', cost, inverse)
        worst = int(prices.argmin())
        if prices[worst] < -1e-9:  # a surplus column
            column, price = np.zeros(m), 0.0
            column[worst] = -1
        else:
            best, column = best_pattern(prices, sizes, capacity)
            price = 1.0
            if best <= 1 + gap:  # value / best bounds the optimum from below
                break
        u = np.einsum('ij,j->i', inverse, column)
        up = u > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, u, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out], cost[out] = column, price
        pivot = inverse[out] / u[out]
        inverse -= np.outer(u, pivot)
        inverse[out] = pivot
        moved = x[out] / u[out]
        x = np.maximum(x - moved * u, 0)
        x[out] = moved
    used = [(columns[:, k].astype(np.int64), int(np.floor(x[k]))) for k in range(m) if cost[k] == 1]
    used = [(p, n) for p, n in used if n > 0]
    left = demand.astype(np.int64) - sum((p * n for p, n in used), np.zeros(m, np.int64))
    left = np.maximum(left, 0)  # surplus columns give slots that stay empty
    while left.any():
        pattern, room = np.zeros(m, np.int64), capacity
        for k in range(m - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= pattern[k] * sizes[k]
        on = pattern > 0
        n = int((left[on] // pattern[on]).min())
        used.append((pattern, n))
        left -= pattern * n
    return used


def pack(pieces: DataFrame, most: int = SEQUENCE_TOKENS, grain: int = GRAIN) -> DataFrame:
    """Give each piece a place: its columns, sequence_id and offset.

    pieces: token_pieces(), or any rows with doc_id, start and length from 1 to most. Sequences are
    filled from offset 0 without gaps and never beyond most. Equal rows are separate pieces. Places
    follow from the rows alone, not from the order in which they come, so a task that runs again gives
    the same ones. An empty input gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("bin", F.ceil(F.col("length") / grain).cast("int"))
    histogram = pieces.groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect()  # at most most / grain rows
    sizes, demand = (np.array([row[k] for row in histogram], np.int64) for k in (0, 1))
    slots, base, taken = [], 0, dict.fromkeys(sizes.tolist(), 0)
    for pattern, n in cutting_stock(sizes, demand.astype(float), most // grain):
        for size, each in zip(sizes.tolist(), pattern.tolist(), strict=True):
            if each:
                slots.append((size, taken[size], taken[size] + each * n, each, base))
                taken[size] += each * n
        base += n
    plan = local_rows(spark, slots, "bin int, low long, high long, each long, base long")
    # Ranks within a bin: a hash deals its pieces to parts of bounded size, and the parts' counts give where each begins.
    deal = local_rows(spark, [(size, -(-n // RANKED_ROWS)) for size, n in zip(sizes.tolist(), demand.tolist(), strict=True)], "bin int, parts long")
    own = [c for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens") if c in pieces.columns]  # rows equal in these are interchangeable
    dealt = pieces.join(F.broadcast(deal), "bin").withColumn("part", F.pmod(F.xxhash64(*own), F.col("parts"))).drop("parts")
    begins = dealt.groupBy("bin", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # Each part meets the slots that its range of ranks overlaps, mostly one or two. The plan's size depends on most and grain alone.
    begins = begins.join(F.broadcast(plan), "bin").where("low < begin + n and high > begin").groupBy("bin", "part", "begin").agg(F.collect_list(F.struct("low", "high", "each", "base")).alias("slots"))
    within = Window.partitionBy("bin", "part").orderBy(*own)
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(begins, ["bin", "part"]).withColumn("rank", F.col("rank") + F.col("begin"))
    placed = ranked.withColumn("slot", F.expr("element_at(filter(slots, x -> rank >= x.low and rank < x.high), 1)"))
    placed = placed.withColumn("sequence_id", F.col("slot.base") + F.floor((F.col("rank") - F.col("slot.low")) / F.col("slot.each")))
    filled = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *own, "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(filled), F.lit(0)))
    return placed.drop("bin", "part", "rank", "begin", "slots", "slot")


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, most: int = SEQUENCE_TOKENS) -> DataFrame:
    """Tokenise and pack: (doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset).

    Null and empty texts are the end id alone. Every id of every row lies in exactly one piece.
    """
    return pack(materialize(token_pieces(df, path, id_col, text_col, most, with_ids=with_ids), "pieces"), most)
