"""Packing: token pieces into fixed-length sequences by first-fit decreasing over a tournament tree of capacities."""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcase.llm.common import text_slices

LENGTH, END = 4096, 2
#: Documents and text bytes of a group: large enough for almost no waste in its last sequences, small enough for one task's memory.
GROUP_ROWS, GROUP_BYTES = 2000, 32_000_000
#: Words that a worker keeps (760,000 were measured at 178 MB, MEMO_SMALL at 97 MB), and characters of the longest one.
MEMO, MEMO_SMALL, MEMO_WORD = 1_000_000, 340_000, 64


class Tournament:
    """Bins in order of opening; a node holds the largest free capacity below it.

    ``first_fit`` goes down to the leftmost bin with enough room and updates the path back to the root: a number of
    steps logarithmic in the bins. Bins that are still closed count as full capacity, so opening one is no special case.
    """

    def __init__(self, bins: int, capacity: int):
        self.base = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.base)
        self.capacity = capacity

    def first_fit(self, size: int) -> tuple[int, int]:
        """Bin for ``size`` and the offset there."""
        best, base, p = self.best, self.base, 1
        while p < base:
            p *= 2
            if best[p] < size:
                p += 1
        offset = self.capacity - best[p]
        best[p] -= size
        found = p - base
        while p > 1:
            p >>= 1
            a, b = best[2 * p], best[2 * p + 1]
            best[p] = a if a > b else b
        return found, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, none above ``capacity``; equal sizes go in the given order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if len(sizes):
        tree = Tournament(len(sizes), capacity)
        for i in np.argsort(-sizes, kind="stable").tolist():
            bins[i], offsets[i] = tree.first_fit(int(sizes[i]))
    return bins, offsets


class Words(dict):
    """Packed ids of the words met so far, by the tokenizers library."""

    # Fixed value: the vocabulary file's own pre-tokenizer pattern, for text within Latin-1.
    pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.memo = memo

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word == word.lower():
            ids = [t.id for t in self.model.tokenize(word)]  # one piece, and each letter is its own byte character
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = array("i", ids).tobytes()
        if len(word) <= MEMO_WORD:
            if len(self) >= self.memo:
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """Words between blanks and line ends one by one: no piece, composition or special token crosses them."""
        try:
            text.encode("latin-1")
            text = text.lower()  # the vocabulary's own first step; within Latin-1 it is the same in any order
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@functools.cache
def words(path: str, memo: int = MEMO) -> Words:
    return Words(path, memo)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, doc_id: str = "doc_id", text: str = "text", memo: int = MEMO) -> DataFrame:
    """(doc_id, start, ids binary, doc_tokens): each document's ids and ``end``, cut at multiples of ``length``.

    ``ids`` are little-endian unsigned 32-bit integers. A null or empty text is the end id alone. A worker keeps at most
    ``memo`` words with their ids, which decides its memory and time, not the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, step, last = words(path, memo), 4 * length, array("i", [end]).tobytes()
        for batch in text_slices(batches):
            keys, starts, parts, totals = [], [], [], []
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = known.ids(value or "") + last
                for at in range(0, len(ids), step):
                    keys.append(key)
                    starts.append(at // 4)
                    parts.append(ids[at : at + step])
                    totals.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary()), pa.array(totals, pa.int64())],
                names=["doc_id", "start", "ids", "doc_tokens"],
            )
        pa.default_memory_pool().release_unused()

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, ids binary, doc_tokens long")


def packed(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, group_rows: int = GROUP_ROWS, seed: int = 7, memo: int = MEMO) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): every piece with its place.

    Pieces go to randomised groups by a hash of the id, the start, the checksum of the ids and the row's place, so that
    rows that repeat spread too; the groups' number follows the rows and the bytes. Each group is packed alone by first-fit
    decreasing. Full pieces fill a sequence of their own. A null id is an id of its own; repeated rows are packed each; an
    empty table gives an empty one.
    """
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-rows // group_rows), -(-size // GROUP_BYTES))
    split = pieces(docs, path, length, end, memo=memo)
    # A row's place is the same whenever its split of the input is read again.
    where = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", F.crc32("ids"), F.monotonically_increasing_id()), F.lit(groups))

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        sizes = pc.binary_length(group["ids"]).to_numpy().astype(np.int64) // 4
        bins, offsets = first_fit_decreasing(sizes, length)
        return pa.table({
            "doc_id": group["doc_id"], "start": group["start"], "length": sizes, "ids": group["ids"], "doc_tokens": group["doc_tokens"],
            "sequence_id": (group["group"].to_numpy() << 32) + bins, "offset": offsets,
        })

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return split.withColumn("group", where).groupBy("group").applyInArrow(place, schema)
