"""Toxicity by compression distance: windows cost fewer bytes under a dictionary of toxic text than of ordinary text."""

from __future__ import annotations

import dataclasses
import heapq
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcase.llm.common import in_fold, text_slices

#: Labelled rows of each class that are fitted on at most; every other step covers all rows.
SAMPLE = 5000
#: Bytes of ordinary text in both dictionaries and of toxic text in the toxic one.
ORDINARY_BYTES, TOXIC_BYTES = 60_000, 32_000
#: Words of a window, and bytes after which a window of long words is cut.
WINDOW_WORDS, WINDOW_BYTES = 10, 400
#: The compressor starts no match in an input's last bytes; blanks keep a window's last word comparable.
TAIL = b" " * 8
#: Bytes of the shortest match: a word of three letters between blanks.
MIN_MATCH = 5
#: Words of the longest phrase that may mark a text.
PHRASE = 3
#: Share of the documents with a mark that must be toxic.
PURITY = 0.75
WORD = re.compile(r"[^\W\d_]+")


@dataclasses.dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]


def windows(text: str) -> list[bytes]:
    """All words of the text, lower-cased, in runs of WINDOW_WORDS; none of an empty text."""
    words, found = text.lower().encode("utf-8", "replace").split(), []
    for at in range(0, len(words), WINDOW_WORDS):
        run = b" " + b" ".join(words[at : at + WINDOW_WORDS])
        if len(run) <= 2 * WINDOW_BYTES:
            found.append(run + TAIL)
        else:
            found += [run[k : k + WINDOW_BYTES] + TAIL for k in range(0, len(run), WINDOW_BYTES)]
    return found


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=17, search_log=4, min_match=MIN_MATCH, target_length=64,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=params)


class Gains:
    """The three largest numbers of bytes that the toxic dictionary saves over the ordinary one in any window."""

    def __init__(self, model: Model):
        self.ordinary, self.toxic = compressor(model.ordinary), compressor(model.toxic)

    def __call__(self, text: str) -> list[int]:
        a, b = self.ordinary.compress, self.toxic.compress
        best = heapq.nlargest(3, [len(a(w)) - len(b(w)) for w in windows(text)])
        return [min(15, max(0, g)) for g in best] + [0] * (3 - len(best))


def unlike(texts: Iterable[str]) -> list[str]:
    """Texts less those that share most of their smallest word triples with earlier ones: copies aren't evidence."""
    seen: set[int] = set()
    kept = []
    for text in texts:
        w = text.lower().split()
        marks = heapq.nsmallest(8, {zlib.crc32(" ".join(t).encode("utf-8", "replace")) for t in zip(w, w[1:], w[2:])})
        if sum(m in seen for m in marks) <= len(marks) // 2:
            kept.append(text)
        seen.update(marks)
    return kept


def marks_of(text: str) -> set[bytes]:
    """What may mark a text: its words, how its longer words begin, and its phrases."""
    found = set()
    for word in set(WORD.findall(text.lower())):
        found.add(f" {word} ".encode("utf-8", "replace"))
        found.update(f" {word[:n]}".encode("utf-8", "replace") for n in range(4, min(len(word), 11)))
    words = text.lower().encode("utf-8", "replace").split()
    for n in range(2, PHRASE + 1):
        found.update(b" %s " % b" ".join(run) for run in zip(*(words[k:] for k in range(n))))
    return found


def counted(texts: list[str], wanted: Callable[[bytes], bool]) -> Counter:
    """Texts with each wanted mark."""
    found: Counter = Counter()
    for text in texts:
        found.update(filter(wanted, marks_of(text)))
    return found


def repeated(texts: list[str]) -> set[int]:
    """crc32 of all marks that more than one text has; few marks have, and only those are counted."""
    every = [np.unique(np.array([zlib.crc32(m) for m in marks_of(t)], np.uint32)) for t in texts]
    value, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *every]), return_counts=True)
    return set(value[n > 1].tolist())


def dictionaries(toxic: list[str], ordinary: list[str], odds: float = 1.0) -> tuple[bytes, bytes]:
    """Dictionary contents (ordinary, toxic); ``odds`` are those of a toxic label among all labels by those in the sample.

    Both hold the same ordinary windows. The toxic one goes on with what marks toxic texts: words, beginnings of words and
    phrases whose share of toxic documents is above chance by a likelihood ratio that allows for the number of marks tried. The
    strongest come last, where a match costs least.
    """
    toxic, ordinary = unlike(toxic), unlike(ordinary)
    draw = random.Random(11)
    picked = [w[: -len(TAIL)] for found in map(windows, ordinary) for w in draw.sample(found, min(12, len(found)))]
    draw.shuffle(picked)
    base = b"".join(picked)[:ORDINARY_BYTES]
    twice = repeated(toxic)
    inside = counted(toxic, lambda m: zlib.crc32(m) in twice)
    outside = counted(ordinary, inside.__contains__)
    share = len(toxic) / max(1, len(toxic) + len(ordinary))
    least = math.log(1 + sum(n > 1 for n in inside.values())) + 2

    def evidence(word: bytes) -> float:
        a, b = inside[word], outside[word]
        q = a / (a + b)
        if q < share or a * odds / (a * odds + b) < PURITY or a < 2:
            return 0.0
        return a * math.log(q / share) + (b * math.log((1 - q) / (1 - share)) if b else 0.0)

    marks = sorted(((score, mark) for mark in inside if (score := evidence(mark)) > least), key=lambda x: (-x[0], -len(x[1]), x[1]))
    content = b""
    for _, mark in marks:
        if len(content) + len(mark) <= TOXIC_BYTES and mark not in content:
            content = mark + content
    return base, base + content + TAIL  # nor does it index the last bytes of a dictionary


def calibrated(rows: np.ndarray, labels: np.ndarray) -> list[float]:
    """Weights of a logistic curve over the gains (constant last), by Newton steps with a small ridge."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (labels - p) - 0.05 * w)
    return w.tolist()


def fit(toxic: list[str], ordinary: list[str], odds: float = 1.0) -> Model:
    """Dictionaries from three quarters of each class, the threshold's curve from the rest (all, if that is too few).

    Where the classes were sampled at different rates, ``odds`` (the ordinary rate by the toxic one) puts purity and the
    curve's constant back to the odds of all labels.
    """
    quarter = lambda texts: ([t for k, t in enumerate(texts) if k % 4], [t for k, t in enumerate(texts) if k % 4 == 0])
    (toxic_fit, toxic_rest), (ordinary_fit, ordinary_rest) = quarter(toxic), quarter(ordinary)
    model = Model(*dictionaries(toxic_fit, ordinary_fit, odds), [0.0] * 4)
    gains = Gains(model)
    rows = np.array([gains(t) for t in toxic_rest + ordinary_rest], dtype=float).reshape(-1, 3)
    labels = np.array([1.0] * len(toxic_rest) + [0.0] * len(ordinary_rest))
    model.weights = calibrated(rows, labels) if len(labels) else [0.0, 0.0, 0.0, -5.0]
    model.weights[-1] += math.log(odds)
    return model


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, held: int = 0) -> Model:
    """A model from at most ``sample`` labelled documents of each class outside fold ``held``, the first by a hash of
    the id. Those rows only come to the driver; rows with null ids, labels or texts are not used. The classes' true odds are
    counted over all labels, so that thresholds mean the same at every size."""
    usable = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    usable = usable.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~in_fold(F.col("doc_id"), folds, held))
    all_ = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    rate = [min(1.0, sample / all_[y]) if all_.get(y) else 1.0 for y in (0, 1)]
    order = F.xxhash64("doc_id")
    chosen = usable.filter("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(usable.filter("toxic = 0").orderBy(order, "doc_id").limit(sample))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").collect()  # at most 2 * sample ids
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows if r["toxic"]], [r["text"] for r in rows if not r["toxic"]], rate[0] / rate[1])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, gain): the probability that a text is toxic, and the bytes its best window saved.

    Every word of the whole text is in a window. Null and empty texts have no window and get the curve's value at no
    gain. Rows are independent: repeated rows and null ids give a row each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, weights = Gains(model), np.array(model.weights)
        for batch in text_slices(batches):
            found = np.array([gains(t or "") for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(found @ weights[:3] + weights[3], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(found[:, 0])], names=["doc_id", "score", "gain"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, gain double")


def filtered(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``below``; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, weights = Gains(model), np.array(model.weights)
        for batch in text_slices(batches):
            found = np.array([gains(t or "") for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, 3)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(found @ weights[:3] + weights[3], -30, 30))) < below))

    return docs.mapInArrow(run, docs.schema)
