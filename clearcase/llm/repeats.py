"""Arrays inside the tasks of the repeated-string operator: anchors of a text, columns of a collection.

Texts are cut at anchors so that the strings of a group stand in aligned columns. The collection's Burrows-Wheeler
transform and its common prefixes are then built column by column, from the last to the first: each round inserts one
symbol of every string that has the column, as the multi-document construction does, and the order of the suffixes of
one column follows from the order of the column after it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
APART = -(1 << 14)


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.ones(size, np.uint64)
    up[1:] = BASE
    down = np.ones(size, np.uint64)
    down[1:] = pow(BASE, -1, 1 << 64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes, by running sums of a polynomial."""
    up, down = _powers(PIECE + 1024)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.size], out=sums[1:])
    found = (sums[gram:] - sums[:-gram]) * down[: data.size - gram + 1]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    return found


def anchors(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first start, starts, anchor's distance from the first start, its hash) for runs of starts with one anchor.

    The anchor of the ``length`` bytes from a start is the ``gram`` in them of least hash, the leftmost of equals; equal
    strings have equal anchors wherever they stand. Long texts go in pieces, which only splits runs.
    """
    width = length - gram + 1
    for low in range(0, data.size - length + 1, PIECE):
        piece = data[low : low + PIECE + length - 1]
        hashes = gram_hashes(piece, gram)
        starts = piece.size - length + 1
        keys = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(hashes.size, dtype=np.uint64)
        if width > 1:
            blocks = np.full(-(-keys.size // width) * width, np.iinfo(np.uint64).max, np.uint64)
            blocks[: keys.size] = keys
            blocks = blocks.reshape(-1, width)
            ahead = np.minimum.accumulate(blocks, axis=1).ravel()
            behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
            keys = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
        at = (keys & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        count = np.diff(np.append(first, starts))
        yield first + low, count, at[first] - first, hashes[at[first]].view(np.int64)


def fingerprint(part: memoryview | bytes) -> tuple[int, int]:
    """128 bits of a string, as two signed numbers."""
    found = hashlib.blake2b(part, digest_size=16).digest()
    return int.from_bytes(found[:8], "big", signed=True), int.from_bytes(found[8:], "big", signed=True)


def _least_between(common: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """min(common[after+1 .. upto]) of each pair."""
    found = common[upto]
    far = np.flatnonzero(upto - after > 1)
    if far.size:
        ends = np.empty(2 * far.size, np.int64)
        ends[0::2], ends[1::2] = after[far] + 1, upto[far] + 1
        found[far] = np.minimum.reduceat(np.append(common, common.dtype.type(APART)), ends)[0::2]
    return found


def repeated_starts(groups: np.ndarray, before: np.ndarray, starts: np.ndarray, strings: list[bytes], length: int) -> np.ndarray:
    """flags[f, s]: whether the ``length`` bytes from start ``s`` of string ``f`` also stand in another string of its group.

    ``groups`` are at most 65,536 small numbers; ``before`` is the distance of the anchor from the string's first byte;
    the string has ``starts + length - 1`` bytes. Rounds go over the columns from the right. ``order`` holds the strings
    by group and suffix of the column (so the symbols taken in this order are the column's part of the transform),
    ``common`` the length of the common prefix with the one before. A round sorts stably by the new symbol; the common
    prefix of two that have it is one more than the least one between them.
    """
    many = len(strings)
    low, high = int(-before.max()), int((starts + length - 1 - before).max())
    columns = np.zeros((high - low, many), np.uint8)
    for f, s in enumerate(strings):
        columns[-before[f] - low : -before[f] - low + len(s), f] = np.frombuffer(s, np.uint8)
    flags = np.zeros((high - low - length + 1, many), bool)
    groups = groups.astype(np.uint16)
    ends = starts + length - 1 - before - low
    begins = -before - low
    entering = np.lexsort((groups, -ends))
    entered = np.searchsorted(-ends[entering], -np.arange(high - low, -1, -1), side="right")
    leaving = set(begins.tolist())
    order = np.zeros(0, np.int64)
    common = np.zeros(0, np.int16)
    done = 0
    for j in range(high - low - 1, -1, -1):
        upto = entered[high - low - (j + 1)]
        if upto > done:  # an empty suffix stands first in its group
            fresh = upto - done
            order = np.concatenate((entering[done:upto], order))
            common = np.concatenate((np.zeros(fresh, np.int16), common))
            by = np.argsort(groups[order], kind="stable")
            order, common, new = order[by], common[by], by < fresh
            common[1:][new[:-1]] = 0
            g = groups[order]
            common[0] = APART
            common[1:][g[1:] != g[:-1]] = APART
            done = upto
        if not order.size:
            continue
        symbol, g = columns[j, order], groups[order]
        same = g[1:] == g[:-1]
        if np.all((symbol[1:] >= symbol[:-1]) | ~same):
            grown = np.where(same, np.where(symbol[1:] == symbol[:-1], common[1:] + 1, 0), APART)
        else:
            by = np.argsort(symbol, kind="stable")
            by = by[np.argsort(g[by], kind="stable")]
            order, symbol, g = order[by], symbol[by], g[by]
            same = g[1:] == g[:-1]
            alike = np.flatnonzero(same & (symbol[1:] == symbol[:-1]))
            grown = np.where(same, 0, APART)
            grown[alike] = _least_between(common, by[alike], by[alike + 1]) + 1
        common = np.concatenate((np.array([APART], np.int16), grown.astype(np.int16)))
        if j < flags.shape[0]:
            equal = np.flatnonzero(common >= length)
            flags[j, order[equal]] = True
            flags[j, order[equal - 1]] = True
        if j in leaving:
            stay = np.flatnonzero(begins[order] != j)
            if stay.size < order.size:
                if stay.size:
                    common = np.minimum.reduceat(common[: stay[-1] + 1], np.concatenate(([0], stay[:-1] + 1)))
                else:
                    common = common[:0]
                order = order[stay]
    wide = int(starts.max())
    where = begins[:, None] + np.arange(wide)
    return flags[np.minimum(where, flags.shape[0] - 1), np.arange(many)[:, None]] & (np.arange(wide) < starts[:, None])


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans."""
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by])
    cut = np.flatnonzero(begin[1:] > end[:-1])
    return begin[np.concatenate(([0], cut + 1))], end[np.append(cut, begin.size - 1)]
