"""Operator 9, SentencePiece encoding and decoding by vectorised merge rounds.

Symbols of many words lie in flat numpy arrays. Each round finds every word's minimum pair rank,
merges that pair's leftmost occurrences in all words at once, and drops the words that have no pair
left. The model's file comes as a path parameter, which every executor must be able to open.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, map_arrow

SPACE = "▁"
#: No pair.
NONE = np.iinfo(np.int32).max
#: Words kept with their ids, and words encoded at once.
CACHE_WORDS = 200_000


class Pieces:
    """A SentencePiece BPE model with byte fallback, no user-defined or unused pieces and no normalisation but the space mark."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if len(sp.encode("a  b")) == 0 or any(SPACE in names[i].lstrip(SPACE) for i in normal) or sp.normalize(" a  é①") not in (f"{SPACE}{SPACE}a{SPACE}{SPACE}é①",):
            raise ValueError("a model of another kind: words can't be encoded one by one")
        ids = {names[i]: i for i in normal}
        # Characters that are in pieces without being one get symbols after the last id.
        loose = sorted({c for i in normal for c in names[i]} - ids.keys())
        symbols = ids | {c: n + k for k, c in enumerate(loose)}
        self.size = n + len(loose)
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in (x for x in symbols if len(x) == 1):
            self.of_char[ord(c)] = symbols[c]
        scores = np.array([sp.get_score(i) for i in normal])
        rank = dict(zip(normal, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        pairs = {}
        for i in normal:
            for cut in range(1, len(names[i])):
                a, b = symbols.get(names[i][:cut]), symbols.get(names[i][cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (rank[i], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank, self.into = np.array([pairs[k] for k in self.keys.tolist()], np.int32).reshape(-1, 2).T.copy()
        self.byte_ids = np.zeros(256, np.int64)
        blocks = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(names[i][3:5], 16)
                self.byte_ids[value], blocks[i] = i, bytes([value])
            elif sp.is_unknown(i):
                blocks[i] = b" \xe2\x81\x87 "
            elif not sp.is_control(i):
                blocks[i] = names[i].replace(SPACE, " ").encode()
        self.block_size = np.array(list(map(len, blocks)), np.int64)
        self.block_at = np.cumsum(self.block_size) - self.block_size
        self.block = np.frombuffer(b"".join(blocks), np.uint8)
        # What may follow a letter inside a piece counts as one, so that no piece crosses from a letter to anything else.
        letters, inner = {c for c in symbols if len(c) == 1 and c.isalpha()}, {(a, b) for i in normal for a, b in zip(names[i], names[i][1:])}
        while more := {b for a, b in inner if a in letters} - letters:
            letters |= more
        kind = "".join(map(re.escape, sorted(letters)))
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{kind}]*[{kind}]+|{SPACE}*[^{SPACE}{kind}]+|{SPACE}+").findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged symbols of pairs."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], NONE), self.into[at]

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        symbol = self.of_char[chars].astype(np.int64)
        done_word, done_symbol, done_char = [], [], []

        def pairs(symbol, word):
            rank = np.full(symbol.size, NONE, np.int32)
            into = np.zeros(symbol.size, np.int32)
            if symbol.size > 1:
                rank[:-1], into[:-1] = self._pair(symbol[:-1], symbol[1:])
                rank[:-1][word[1:] != word[:-1]] = NONE
            return rank, into

        rank, into = pairs(symbol, word)
        while symbol.size:
            starts = np.nonzero(np.r_[True, word[1:] != word[:-1]])[0]
            counts = np.diff(np.r_[starts, symbol.size])
            least = np.repeat(np.minimum.reduceat(rank, starts), counts)
            over = least == NONE
            if over.any():  # these words have no pair left
                done_word.append(word[over])
                done_symbol.append(symbol[over])
                done_char.append(chars[over])
                stay = ~over
                word, symbol, chars, rank, into, least = (x[stay] for x in (word, symbol, chars, rank, into, least))
                if not symbol.size:
                    break
            wanted = rank == least
            place = np.arange(symbol.size)
            run = np.maximum.accumulate(np.where(wanted & ~np.r_[False, wanted[:-1]], place, 0))
            take = wanted & ((place - run) % 2 == 0)
            while True:
                keep = ~np.r_[False, take[:-1]]
                new_symbol, new_word = np.where(take, into, symbol)[keep], word[keep]
                fresh = take[keep]
                touched = np.nonzero(fresh | np.r_[fresh[1:], False])[0]
                new_rank, new_into = rank[keep], into[keep]
                nxt = np.minimum(touched + 1, new_symbol.size - 1)
                r, m = self._pair(new_symbol[touched], new_symbol[nxt])
                r[(nxt == touched) | (new_word[nxt] != new_word[touched])] = NONE
                new_rank[touched], new_into[touched] = r, m
                # A new pair that comes before the other occurrences of the one just merged: then one at a time.
                early = np.unique(new_word[touched[r <= least[keep][touched]]])
                if early.size:
                    hasty = np.isin(word, early) & take
                    at = np.nonzero(hasty)[0]
                    extra = at[np.r_[False, word[at][1:] == word[at][:-1]]] if at.size else at
                    if extra.size:
                        take = take.copy()
                        take[extra] = False
                        continue
                break
            symbol, word, chars, rank, into = new_symbol, new_word, chars[keep], new_rank, new_into
        if not done_word:
            return [b""] * len(words)
        word, symbol, chars = np.concatenate(done_word), np.concatenate(done_symbol), np.concatenate(done_char)
        order = np.argsort(word, kind="stable")
        word, symbol, chars = word[order], symbol[order], chars[order]
        unknown = np.nonzero((symbol < 0) | (symbol >= self.block_size.size))[0]
        if unknown.size:  # a character outside the vocabulary becomes its UTF-8 bytes
            repeats = np.ones(symbol.size, np.int64)
            code = chars[unknown]
            repeats[unknown] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            octets = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            lost = np.zeros(symbol.size, bool)
            lost[unknown] = True
            word, symbol, lost = np.repeat(word, repeats), np.repeat(symbol, repeats), np.repeat(lost, repeats)
            symbol[lost] = self.byte_ids[octets]
        ends = np.searchsorted(word, np.arange(len(words)), side="right") * 4
        flat = symbol.astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts as little-endian unsigned 32-bit integers, without begin and end.

        Texts are cut where no piece crosses, before a space mark and after letters, so each different
        segment is encoded once. Of two generations of known segments the older one is dropped when
        the newer one is full.
        """
        split = [self.segments(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        new = set().union(*split) - cache.keys()
        again = new & older.keys()
        cache.update((x, older[x]) for x in again)
        new = list(new - again)
        for at in range(0, len(new), CACHE_WORDS // 4):
            part = new[at : at + CACHE_WORDS // 4]
            cache.update(zip(part, self.merge_words(part), strict=True))
        return [b"".join(map(cache.__getitem__, x)) for x in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: pieces joined, space marks turned to spaces, the space that encoding put first taken off."""
        ids = np.asarray(ids, np.int64)
        sizes = self.block_size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if ends.size else 0
        out = self.block[np.repeat(self.block_at[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()
        try:
            out.decode()
        except UnicodeDecodeError:  # byte pieces that are no UTF-8: the library says how they are replaced
            return self.library.decode(ids.tolist()).encode()
        first = ids[self.block_size[ids] > 0][:1]
        return out[1:] if out[:1] == b" " and not self.library.is_unknown(int(first[0])) else out


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode and decode every whole text: (doc_id, ids, decoded), or with digests (doc_id, n_tokens, ids_sha256, decoded_sha256).

    ids have begin and end. A null text is encoded as the empty one. One row per input row.
    """

    def make():
        model = load(path)
        first, last = (np.array([x], "<u4").tobytes() for x in (model.bos, model.eos))

        def run(part: pa.RecordBatch) -> dict:
            ids = [first + x + last for x in model.encode([x or "" for x in part.column(1).to_pylist()])]
            arrays = [np.frombuffer(x, "<u4") for x in ids]
            texts = [model.decode(x) for x in arrays]
            if digests:
                return {"doc_id": part.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in texts]}
            offsets = np.cumsum([0, *map(len, arrays)])
            flat = np.concatenate(arrays).astype(np.int32)
            return {"doc_id": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), "decoded": [x.decode() for x in texts]}

        return run

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return map_arrow(df.select(column(df, id_col, "doc_id", "long"), column(df, text_col, "text", "string")), make, schema)
