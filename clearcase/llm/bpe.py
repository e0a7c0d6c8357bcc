"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding."""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from clearcase.llm.common import text_slices

NONE = 1 << 62
#: Entries kept per worker; a full memo is emptied, which costs time only.
MEMO = 1_000_000
# White space as the vocabulary's own normalizer sees it (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# Fixed value: the vocabulary file's own pre-tokenizer pattern.
PIECES = regex.compile("'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^" + SPACE + "\\p{L}\\p{N}]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairRankTree:
    """Merges of one symbol sequence.

    Leaf i holds ``rank * 2^shift + i`` for the pair that begins at symbol i, or NONE. The root is then the leftmost
    pair of the lowest rank. A merge changes at most three leaves, each in a logarithmic number of steps.
    """

    def __init__(self, symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.symbols, self.merges, n = symbols, merges, len(symbols)
        self.after, self.before = list(range(1, n + 1)), list(range(-1, n - 1))
        self.base = 1 << max(0, (n - 2).bit_length())
        self.shift = self.base.bit_length()
        self.tree = tree = [NONE] * (2 * self.base)
        for i in range(n - 1):
            tree[self.base + i] = self._key(i)
        for p in range(self.base - 1, 0, -1):
            a, b = tree[2 * p], tree[2 * p + 1]
            tree[p] = a if a < b else b

    def _key(self, i: int) -> int:
        j = self.after[i]
        if j >= len(self.symbols):
            return NONE
        found = self.merges.get((self.symbols[i], self.symbols[j]))
        return NONE if found is None else (found[0] << self.shift) | i

    def _put(self, i: int, key: int) -> None:
        tree, p = self.tree, self.base + i
        tree[p] = key
        while p > 1:
            other = tree[p ^ 1]
            p >>= 1
            best = key if key < other else other
            if tree[p] == best:
                return
            tree[p] = key = best

    def merged(self) -> list[int]:
        symbols, after, before, n = self.symbols, self.after, self.before, len(self.symbols)
        if n < 2:
            return symbols
        mask = (1 << self.shift) - 1
        while (root := self.tree[1]) != NONE:
            i = root & mask
            j = after[i]
            k = after[j]
            symbols[i] = self.merges[symbols[i], symbols[j]][1]
            after[i] = k
            symbols[j] = -1
            if k < n:
                before[k] = i
            if j < n - 1:
                self._put(j, NONE)
            self._put(i, self._key(i))
            if before[i] >= 0:
                self._put(before[i], self._key(before[i]))
        return [s for s in symbols if s >= 0]


class Vocabulary:
    """A word-end BPE vocabulary: pieces to ids and back, remembering the words it has met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a in self.ids and b in self.ids and a + b in self.ids:
                self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        characters = byte_characters()
        self.inner = [self.ids.get(c) for c in characters]
        self.final = [self.ids.get(c + self.end) for c in characters]
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.pieces: dict[str, list[int]] = {}
        self.words: dict[str, tuple[bytes, str]] = {}

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece (a run that merges cannot leave)."""
        found = self.pieces.get(piece)
        if found is None:
            data = piece.encode("utf-8", "surrogatepass")
            symbols = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
            found = PairRankTree([s for s in symbols if s is not None], self.merges).merged()
            if len(self.pieces) >= MEMO:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def plain(self, text: str) -> list[int]:
        """Ids of text without special tokens: composed, lower-cased by character, cut into pieces, merged."""
        text = unicodedata.normalize("NFC", text)
        # Lower-casing by character: a final sigma is not special.
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        return [i for p in PIECES.findall(text) for i in self.piece(p)]

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.plain(text[at:])

    def word(self, word: str) -> tuple[bytes, str]:
        ids = self.encode(word)
        found = array("i", ids).tobytes(), self.decode(ids)
        if len(self.words) >= MEMO:
            self.words.clear()
        self.words[word] = found
        return found

    def both(self, text: str) -> tuple[bytes, str]:
        """Ids (as packed integers) and decoded text of a whole text.

        No piece crosses a blank or a line end, and no composition, lower-casing or special token does, so the words
        between them are encoded one by one and equal words once.
        """
        known, ids, tokens = self.words, [], []
        for word in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            if word:
                found = known.get(word) or self.word(word)
                if found[1]:
                    ids.append(found[0])
                    tokens.append(found[1])
        return b"".join(ids), " ".join(tokens)

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one blank, special tokens kept: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text.

    A null or empty text, or one of white space only, has no ids and decodes to the empty text. Rows are independent:
    repeated rows and null ids give a row each, other columns are not read, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in text_slices(batches):
            pairs = [vocab.both(t or "") for t in batch.column("text").to_pylist()]
            values = np.frombuffer(b"".join([p[0] for p in pairs]), dtype=np.int32)
            ends = np.cumsum([0] + [len(p[0]) // 4 for p in pairs], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array([p[1] for p in pairs], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
