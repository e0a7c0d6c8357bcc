"""Near-duplicate texts: a chosen-path set similarity join over minwise tokens, confirmed on whole shingle sets."""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcase.llm.common import text_slices, written
from clearcase.llm.components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
SIMILARITY = NUMERATOR / DENOMINATOR
#: Minwise tokens of a document, independent trees, levels of a tree, and the largest node compared exhaustively.
TOKENS, TREES, LEVELS, LEAF = 64, 12, 3, 48
#: Estimated similarity from which a pair of a node is a candidate: 4 standard errors of 64 tokens below the threshold.
CANDIDATE = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / TOKENS) ** 0.5
#: Documents and shingles of a candidate group that one task confirms; larger groups are confirmed in parts.
GROUP, GROUP_SHINGLES = 2000, 2_000_000
#: Rounds in which larger groups are compared with one of their documents.
PIVOTS = 4
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: bits of the input spread over all bits of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): 64-bit hashes of all lower-cased words (A-Z only) of each text, equal words hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)])
    coded = words.filter(pa.array(full)).dictionary_encode()
    known = np.fromiter((struct.unpack("<Q", hashlib.blake2b(w, digest_size=8).digest())[0] for w in coded.dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return kept[ends], known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of WORDS consecutive words; of fewer words, their whole sequence; of none, empty."""
    bounds, words = word_hashes(texts)
    n = len(words)
    with np.errstate(over="ignore"):
        # Runs within the whole array first; those that cross a text's end are not taken.
        rolled = np.zeros(max(0, n - WORDS + 1), np.uint64)
        for k in range(WORDS):
            rolled = mixed(rolled + words[k : k + len(rolled)] + MIX * np.uint64(k + 1))
        found = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= WORDS:
                found.append(np.unique(rolled[a : b - WORDS + 1]))
            elif b > a:
                short = np.zeros(1, np.uint64)
                for k, w in enumerate(words[a:b]):
                    short = mixed(short + w + MIX * np.uint64(k + 1 + WORDS * int(b - a)))
                found.append(short)
            else:
                found.append(np.zeros(0, np.uint64))
    return found


@functools.cache
def seeds() -> np.ndarray:
    return mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * MIX)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the set under each of TOKENS functions, 32 bits of it."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            x = (shingles[at : at + 1024, None] ^ seeds()[None, :]) * np.uint64(0xFF51AFD7ED558CCD)
            best = np.minimum(best, (x ^ (x >> np.uint64(29))).min(axis=0))
        return (mixed(best) >> np.uint64(32)).astype(np.uint32)


def chosen(nodes: np.ndarray) -> np.ndarray:
    """(node x token) choices: every node chooses 1 / SIMILARITY tokens on average, and at least one.

    Two documents of that similarity then share, on average, at least one child of each node they share.
    """
    with np.errstate(over="ignore"):
        draw = mixed(nodes[:, None] ^ (seeds()[None, :] * np.uint64(3)))
    pick = draw < np.uint64(int(2**64 / (SIMILARITY * TOKENS)))
    pick[np.arange(len(nodes)), draw.argmin(axis=1)] = True
    return pick


def children(ids: np.ndarray, nodes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, nodes) below the given nodes: a child is a chosen token's place and value."""
    row, token = np.nonzero(chosen(nodes))
    with np.errstate(over="ignore"):
        below = mixed(nodes[row] + mixed(tokens[row, token].astype(np.uint64) + MIX * (token.astype(np.uint64) + np.uint64(1))))
    return row, below


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def profiles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, key, tokens): set size, digest of the set, minwise tokens. The key of an empty set is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                 pa.array([minwise(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "key", "tokens"],
            )

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, key string, tokens binary")


def whole_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows sorted by ``column``, regrouped so that no run of equal values is cut; only a run's rows are held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        last = int(np.searchsorted(values, values[-1], "left"))
        if held and last == 0 and held[-1].column(column)[-1].as_py() == values[-1]:
            held.append(batch)
            continue
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of the documents of each node whose tokens agree often enough; rows come sorted by node.

    Every pair of a node is compared: rows with the rows one place further, two places further, and so on.
    """
    for nodes in whole_runs(batches, "node"):
        node, ids, tokens = nodes["node"].to_numpy(), nodes["id"].to_numpy(), _tokens(nodes["tokens"].combine_chunks())
        left, right = [], []
        rows, lag = np.arange(len(node)), 1
        while True:
            rows = rows[rows + lag < len(node)]
            rows = rows[node[rows] == node[rows + lag]]
            if not len(rows):
                break
            for at in range(0, len(rows), 20_000):
                i = rows[at : at + 20_000]
                i = i[(tokens[i] == tokens[i + lag]).mean(axis=1) >= CANDIDATE]
                left.append(i)
                right.append(i + lag)
            lag += 1
        if left:
            first = least_labels(len(node), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(first != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first[moved]]), pa.array(ids[moved])], names=["a", "b"])


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first row that each of ``n`` rows is linked to."""
    first = np.arange(n)
    while True:
        least = np.minimum(first[a], first[b])
        np.minimum.at(first, a, least)
        np.minimum.at(first, b, least)
        first = first[first]
        if (first[a] == first[b]).all():
            return first


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b) links over ids of ``classes`` (id, tokens) whose components hold, at the trees' recall, every similar pair.

    All documents start in the root of each tree. A node of more than LEAF documents branches: its chosen tokens deal
    its documents to children. Smaller nodes are compared exhaustively on their tokens. A node that is still large at
    the last level, whose documents agree on LEVELS chosen tokens, is taken as one candidate group. Links are one per
    document and node, so a group of any size costs in proportion to it.
    """

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mixed(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        for batch in batches:
            ids, tokens = batch.column("id").to_numpy(), _tokens(batch.column("tokens"))
            for root in roots:
                row, below = children(ids, np.full(len(ids), root), tokens)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), _signed(below)], names=["id", "node"])

    def branched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = batch.column("id").to_numpy(), _tokens(batch.column("tokens"))
            row, below = children(ids, batch.column("node").to_numpy().view(np.uint64), tokens)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), _signed(below)], names=["id", "node"])

    level = written(classes.select("id", "tokens").mapInArrow(planted, "id long, node long"))
    links = []
    for depth in range(1, LEVELS + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1")
        sizes = written(sizes)
        sized = written(level.join(sizes, "node"))
        leaves = sized.filter(F.col("n") <= LEAF).select("id", "node").join(classes.select("id", "tokens"), "id")
        links.append(leaves.repartition("node").sortWithinPartitions("node", "id").mapInArrow(compared, "a long, b long"))
        large = sized.filter(F.col("n") > LEAF)
        if depth == LEVELS:
            links.append(large.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")))
        elif not large.limit(1).count():
            break
        else:
            level = written(large.select("id", "node").join(classes.select("id", "tokens"), "id").mapInArrow(branched, "id long, node long").distinct())
    found = functools.reduce(DataFrame.unionByName, links)
    return written(found.distinct())


class Sets:
    """Shingle sets of one task, one after another, for comparing one set with many at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])

    def linked(self, one: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` are similar to ``one``."""
        sizes = self.sizes[others]
        # Sets whose sizes alone rule it out are not compared.
        fit = (DENOMINATOR * np.minimum(sizes, len(one)) >= NUMERATOR * np.maximum(sizes, len(one)))
        others = others[fit]
        if not len(others):
            return others
        flat = np.concatenate([self.sets[k] for k in others])
        at = np.searchsorted(one, flat)
        at[at == len(one)] = 0
        hits = np.concatenate([[0], np.cumsum(one[at] == flat)])
        ends = np.cumsum(self.sizes[others])
        both = hits[ends] - hits[ends - self.sizes[others]]
        return others[DENOMINATOR * both >= NUMERATOR * (self.sizes[others] + len(one) - both)]

    def groups(self, within: np.ndarray) -> np.ndarray:
        """For each of ``within``, the first one its links reach: a search that compares only what is not yet reached."""
        first, left = within.copy(), within
        place = {int(k): p for p, k in enumerate(within)}
        while len(left):
            start, left = left[0], left[1:]
            queue = [start]
            while queue and len(left):
                near = self.linked(self.sets[queue.pop()], left)
                if len(near):
                    for k in near:
                        first[place[int(k)]] = start
                    left = left[~np.isin(left, near)]
                    queue.extend(near.tolist())
        return first


def confirmed(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b) links that span the components of truly similar documents within each candidate group.

    ``docs`` is (id, text), ``groups`` (id, component, size). Whole sets are made again for grouped documents only. A
    group within one task's bounds is searched there; larger ones as ``confirmed_large`` says.
    """
    sums = groups.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / GROUP, F.col("shingles") / GROUP_SHINGLES)).cast("int")
    sized = written(groups.join(sums, "component").select("id", "component", blocks.alias("blocks")))
    texts = docs.join(sized, "id").select("id", "component", "blocks", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "component", "blocks")), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "component", "blocks", "shingles"],
            )

    sets = texts.mapInArrow(run, "id long, component long, blocks int, shingles binary")
    large = written(sets.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    small = sets.filter("blocks = 1").repartition("component").sortWithinPartitions("component", "id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, "component"):
            ids, group = part["id"].to_numpy(), part["component"].to_numpy()
            sets_ = Sets([np.frombuffer(s, dtype=np.uint64) for s in part["shingles"].to_pylist()])
            ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
            first = np.concatenate([sets_.groups(np.arange(a, b)) for a, b in zip(np.append(0, ends[:-1]), ends)])
            moved = np.flatnonzero(first != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first[moved]]), pa.array(ids[moved])], names=["a", "b"])

    links = small.mapInArrow(each, "a long, b long")
    return links.unionByName(confirmed_large(large)) if large.limit(1).count() else links


def confirmed_large(large: DataFrame) -> DataFrame:
    """Links (a, b) within groups that no task holds; ``large`` is (id, component, blocks, shingles, block), written.

    In each of PIVOTS rounds the first document not reached yet is compared with all of its group, row by row. What the
    links of these pivots connect need not be compared again. Of a group's other documents, if they fit into a block,
    each meets every block of the group, so all pairs outside the largest connected part are covered at a cost in
    proportion to the group. Only if more are left, every pair of blocks meets. Tasks hold two blocks at most and return
    a link per document.
    """

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for one, other in zip(batch.column("shingles").to_pylist(), batch.column("pivot_shingles").to_pylist()):
                a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                hits.append(DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both))
            yield batch.select(["pivot", "id"]).filter(pa.array(hits, pa.bool_()))

    def searched(part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        ids, shingles = part["id"].to_numpy(), part["shingles"].to_pylist()
        first = Sets([np.frombuffer(s, dtype=np.uint64) for s in shingles]).groups(np.arange(len(ids)))
        moved = np.flatnonzero(first != np.arange(len(ids)))
        return pa.table({"a": ids[first[moved]], "b": ids[moved]})

    # Ids are few beside their sets: their tables take tasks by number, not by the width of shuffles.
    tasks = max(large.sparkSession.sparkContext.defaultParallelism, -(-large.count() // 10_000))
    left, edges = written(large.select("id", "component").distinct().coalesce(tasks)), None
    members = left
    for _ in range(PIVOTS):
        pivots = left.groupBy("component").agg(F.min("id").alias("pivot"))
        sets = pivots.join(large.select(F.col("id").alias("pivot"), F.col("shingles").alias("pivot_shingles")), "pivot")
        hits = written(large.select("id", "component", "shingles").join(sets, "component").select("pivot", "id", "shingles", "pivot_shingles").mapInArrow(reached, "pivot long, id long").coalesce(tasks))
        edges = hits if edges is None else edges.unionByName(hits)
        left = written(left.join(hits.select("id").distinct(), "id", "left_anti").coalesce(tasks))
        if not left.limit(1).count():
            break
    edges = edges.select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    labels = components(edges).withColumnRenamed("component", "label")
    parts = members.join(labels, "id", "left").select("id", "component", F.coalesce("label", "id").alias("label"))
    parts = written(parts.coalesce(tasks))
    sizes = parts.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("rest")
    )
    rows = large.join(parts.join(sizes, "component").select("id", (F.col("label") == F.col("main")).alias("in_main"), "rest"), "id").filter("rest > 0")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    few = F.col("rest") <= GROUP
    met = rows.withColumn("other", F.explode(F.when(few & F.col("in_main"), F.array("block")).otherwise(every))).select(
        "component", F.when(few, F.col("other")).otherwise(F.least("block", "other")).alias("low"),
        F.when(few, F.col("other")).otherwise(F.greatest("block", "other")).alias("high"), "id", "shingles",
    )
    return edges.unionByName(met.groupBy("component", "low", "high").applyInArrow(searched, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; links have 100 * intersection >= 75 * union.

    Equal sets are one class, joined once. Candidate groups come from the trees; links are then decided on whole sets.
    A text without words (null, empty, white space) has an empty set and links with nothing. Rows that repeat an id are
    one document, which links with whatever any of its texts does, and a row each in the result. A row with a null id
    links with nothing, has no component and is not kept. An empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    made = written(profiles(rows))
    usable = made.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(usable.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("tokens").alias("tokens"), F.max("n_shingles").alias("size")))
    grouped = components(candidates(classes)).join(classes.groupBy("id").agg(F.sum("size").alias("size")), "id")
    links = confirmed(rows.select(F.col("doc_id").alias("id"), "text"), grouped)
    # An id with several texts ties their classes together.
    several = usable.select("doc_id", "key").distinct().join(usable.groupBy("doc_id").agg(F.countDistinct("key").alias("n")).filter("n > 1").select("doc_id"), "doc_id")
    ties = several.join(classes.select("key", "id"), "key").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    labels = components(links.unionByName(ties))
    found = classes.select("key", "id").join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    result = made.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(found, "key", "left")
    result = result.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
