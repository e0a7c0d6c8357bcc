"""The prefix trie of conversations, rolled up by centroid decomposition."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcase.llm.common import shuffle_width, written

WORD = r"[^\x20\x09-\x0D]+"
#: Nodes of a component that one task splits further; larger ones are split by Spark.
COMPONENT = 20_000
#: Depths that one window adds up.
BLOCK = 1024
ROOT = "root"
ENDS_CHUNK = 1 << 20


def ranked(rows: DataFrame, key: str, *by: Column) -> DataFrame:
    """``rows`` as a written table with ``rank``, from 1, in the order ``by`` within ``key``.

    A key may have more rows than a task should: ranks are counted within ranges of the sorted table, and ranges add what
    stands before them. Rows that are equal in all of ``by`` must not differ.
    """
    order = [F.col(key), *by, F.col("tie")]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = written(placed.drop("tie").withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}))
    counts = placed.groupBy(key, "part").agg(F.count("*").alias("many"))
    before = F.sum("many").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(key, "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(key, "part").orderBy("seq"))
    return placed.withColumn("inside", inside).join(offsets, [key, "part"]).withColumn("rank", F.col("before") + F.col("inside")).drop("inside", "before", "part", "seq")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank from 1, digest, words) of every turn, without its text.

    Turns are ordered by ``turn`` (null first), equal ones by the SHA-256 of role and text.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return ranked(rows, "conv_id", F.col("turn").asc_nulls_first(), F.col("digest")).drop("turn")


def rebuilt(ranked: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turns) and their turns (conv_id, depth, digest, words), with the heads of their block's first.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % block`` (all if fewer, none if absent) and goes on
    with its own after the first ``h``; ``h`` is the unsigned CRC-32 of ``c`` in decimal modulo ``heads``.
    """
    lengths = ranked.groupBy("conv_id").agg(F.max("rank").alias("own"))
    first = F.col("conv_id") - F.col("conv_id") % block
    convs = lengths.select("conv_id", "own", first.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    bases = lengths.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    convs = written(convs.join(bases, "base", "left").select("conv_id", "base", "h", "own", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("taken")))
    head = ranked.filter((F.col("conv_id") % block == 0) & (F.col("rank") < heads)).withColumnRenamed("conv_id", "base")
    opening = convs.select("conv_id", "base", "h").join(head, "base").filter("rank <= h").select("conv_id", F.col("rank").alias("depth"), "digest", "words")
    own = ranked.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words")
    return convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")), opening.unionByName(own)


def _lane(which: int) -> Column:
    text = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), F.col("digest")), 256)
    return F.conv(F.substring(text, 1 + 15 * which, 15), 16, 10).cast("decimal(20,0)")


def trails(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, depth, turns, words, node, parent): the nodes that each conversation goes through, the root left out.

    A prefix is named by sums over its turns of 120 bits of SHA-256(depth, turn), so prefixes of long conversations are
    added up in blocks.
    """
    rows = rows.select("conv_id", "depth", "words", _lane(0).alias("x"), _lane(1).alias("y"), F.floor(F.col("depth") / BLOCK).alias("part"))
    sums = rows.groupBy("conv_id", "part").agg(F.sum("x").cast("decimal(38,0)").alias("sx"), F.sum("y").cast("decimal(38,0)").alias("sy"))
    up = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.select("conv_id", "part", *(F.coalesce(F.sum(c).over(up).cast("decimal(38,0)"), zero).alias(c) for c in ("sx", "sy")))
    run = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    total = [(F.sum(c).over(run) + F.col("s" + c)).cast("decimal(38,0)").alias("t" + c) for c in ("x", "y")]
    rows = rows.join(sums, ["conv_id", "part"]).select("conv_id", "depth", "words", "x", "y", *total)
    name = lambda depth, x, y: F.md5(F.concat_ws(":", depth.cast("string"), x.cast("string"), y.cast("string")).cast("binary"))
    parent = F.when(F.col("depth") == 1, ROOT).otherwise(name(F.col("depth") - 1, (F.col("tx") - F.col("x")).cast("decimal(38,0)"), (F.col("ty") - F.col("y")).cast("decimal(38,0)")))
    return rows.join(convs, "conv_id").select("conv_id", "depth", "turns", "words", name(F.col("depth"), F.col("tx"), F.col("ty")).alias("node"), parent.alias("parent"))


def split_component(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (nodes by rows) in one component whose nodes stand after their parents (-1: its top).

    The centroid is the deepest node that has more than half of the component's weight below and at it. What is below it
    falls apart by its children; its total is added to the nodes from it up to the top; the parts and the rest go on.
    ``weight`` holds each node's weight with all below, and is kept up to date along the same path.
    """
    sums = np.zeros_like(values)
    weight = weight.copy()
    pile = [np.arange(parent.size)]
    part = np.zeros(parent.size, np.int64)
    while pile:
        nodes = pile.pop()
        if nodes.size == 1:
            sums[nodes[0]] += values[nodes[0]]
            continue
        half = nodes[2 * weight[nodes] > weight[nodes[0]]]
        centre = half[np.argmin(weight[half])]
        # Part 0 is the rest, -1 the centroid, others are named by the child on top.
        if centre == nodes[0]:
            part[nodes] = 0
        for v in nodes.tolist():
            p = parent[v]
            if v == centre:
                part[v] = -1
            elif p == centre and p >= 0:
                part[v] = v + 1
            else:
                part[v] = part[p] if v != nodes[0] else 0
        label = part[nodes]
        total = values[nodes[label != 0]].sum(axis=0)
        sums[centre] += total
        v = centre
        while v != nodes[0]:
            v = parent[v]
            sums[v] += total
            weight[v] -= weight[centre]
        by = np.argsort(label, kind="stable")
        label, nodes = label[by], nodes[by]
        pile += [x for x in np.split(nodes, np.flatnonzero(label[1:] != label[:-1]) + 1) if part[x[0]] != -1]
    return sums


def _split_small(rows: DataFrame) -> DataFrame:
    """(node, leaves, saved) of components that fit a task."""

    def whole(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            comp = rows.column("comp").to_pylist()
            last = next((i for i in range(len(comp) - 1, -1, -1) if comp[i] != comp[-1]), -1) + 1
            yield from sums(rows.slice(0, last))
            held = rows.slice(last).to_batches()
        if held:
            yield from sums(pa.Table.from_batches(held))

    def sums(rows: pa.Table):
        comp = rows.column("comp").to_pylist()
        names, parents = rows.column("node").to_pylist(), rows.column("parent").to_pylist()
        weight = rows.column("weight").to_numpy()
        values = np.stack([rows.column("leaf").to_numpy(), rows.column("saved").to_numpy()], axis=1) if comp else None
        found, low = [], 0
        while low < len(comp):
            high = low
            at: dict[str, int] = {}
            while high < len(comp) and comp[high] == comp[low]:
                at[names[high]] = high - low
                high += 1
            parent = np.array([at.get(parents[i], -1) for i in range(low, high)])
            found.append(split_component(parent, weight[low:high], values[low:high]))
            low = high
        if found:
            done = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(done[:, 0]), pa.array(done[:, 1])], names=["node", "leaves", "saved"])

    return rows.select("comp", "depth", "node", "parent", "weight", "leaf", "saved").repartition(shuffle_width(rows.sparkSession), "comp").sortWithinPartitions("comp", "depth").mapInArrow(
        whole, "node string, leaves long, saved long"
    )


def rolled_up(nodes: DataFrame, trail: DataFrame) -> DataFrame:
    """(node, leaves, saved): sums of ``leaf`` and ``saved`` over every subtree of ``nodes``.

    ``nodes`` (node, parent, conv_id, depth, weight, leaf, saved) is a tree; ``weight`` is positive and holds all below.
    ``trail`` (conv_id, depth, node, parent) names a node's ancestor at any depth by one of its conversations. All large
    components are split at their centroids in one round; a centroid's total goes to the nodes between it and the
    component's top. Components that fit a task are split there.
    """
    live = written(nodes.withColumn("comp", F.lit(ROOT)))
    ready, added = [], []
    while True:
        sizes = live.groupBy("comp").agg(F.count("*").alias("many"), F.max("weight").alias("all"), F.min("depth").alias("top"))
        large = written(sizes.filter(F.col("many") > COMPONENT))
        if not large.limit(1).count():
            ready.append(live)
            break
        ready.append(live.join(large, "comp", "left_anti"))
        live = live.join(large.drop("many"), "comp")
        row = F.struct("weight", "node", "conv_id", "depth", "top")
        centres = written(live.filter("2 * weight > all").groupBy("comp").agg(F.min(row).alias("c")).select(
            "comp", F.col("c.node").alias("centre"), F.col("c.conv_id").alias("centre_conv"), F.col("c.depth").alias("centre_depth"), F.col("c.weight").alias("cut"), "c.top"))
        live = live.drop("all", "top").join(centres, "comp").withColumn("next", F.col("centre_depth") + 1)
        steps = trail.select(F.col("conv_id"), F.col("depth").alias("next"), F.col("node").alias("below"), F.col("parent").alias("above"))
        below = live.filter("depth > centre_depth").join(steps, ["conv_id", "next"]).withColumn("part", F.when(F.col("above") == F.col("centre"), F.col("below")))
        rest = live.filter("depth <= centre_depth").withColumn("part", F.when(F.col("node") == F.col("centre"), F.col("node")))
        live = written(rest.unionByName(below.drop("below", "above")))
        totals = live.filter("part IS NOT NULL").groupBy("comp").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
        totals = written(totals.join(centres, "comp"))
        path = totals.join(trail.select(F.col("conv_id").alias("centre_conv"), "depth", "node"), "centre_conv").filter("depth >= top AND depth < centre_depth")
        path = written(path.select("node", "leaves", "saved", "cut").unionByName(totals.filter("top = 0 AND centre_depth > 0").select(F.lit(ROOT).alias("node"), "leaves", "saved", "cut")))
        added += [totals.select(F.col("centre").alias("node"), "leaves", "saved"), path.select("node", "leaves", "saved")]
        moved = live.filter("node <> centre").join(path.select("node", F.col("cut").alias("less")), "node", "left")
        live = written(moved.select(
            "node", "parent", "conv_id", "depth", (F.col("weight") - F.coalesce("less", F.lit(0))).alias("weight"), "leaf", "saved", F.coalesce("part", "comp").alias("comp")))
    small = ready[0]
    for more in ready[1:]:
        small = small.unionByName(more)
    sums = _split_small(small)
    for more in added:
        sums = sums.unionByName(more)
    return sums.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _ends(ends: DataFrame) -> DataFrame:
    """(node, ends): the SHA-256 of the ascending conv_ids of each node, comma-joined.

    Ids are joined in the ranges of the sorted table; one task hashes the pieces of a node, which it never holds at once.
    """

    def joined(batches):
        node, first, ids, size = None, 0, [], 0
        for batch in batches:
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if n != node or size > ENDS_CHUNK:
                    if ids:
                        yield pa.RecordBatch.from_pydict({"node": [node], "first": [first], "ids": [",".join(ids)]})
                    node, first, ids, size = n, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield pa.RecordBatch.from_pydict({"node": [node], "first": [first], "ids": [",".join(ids)]})

    def hashed(batches):
        node, state = None, None
        for batch in batches:
            done = {"node": [], "ends": []}
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if n == node:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    done["node"].append(node), done["ends"].append(state.hexdigest())
                node, state = n, hashlib.sha256(ids.encode())
            if done["node"]:
                yield pa.RecordBatch.from_pydict(done)
        if state:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends": [state.hexdigest()]})

    wide = shuffle_width(ends.sparkSession)
    pieces = ends.select("node", "conv_id").repartitionByRange(wide, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node string, first long, ids string")
    return pieces.repartition(wide, "node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node string, ends string")


def prefix_trie(conversations: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (see ``rebuilt``), the textless root included.

    Columns: conv_id (the least member's), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves and
    saved_tokens (over the subtree: (n_convs - 1) times the words of a node's last text), ends_sha256. A null role or text
    counts as empty; rows without a conv_id are left out; repeated rows are turns of their own; equal turns stand in the
    order of their SHA-256; a conversation that has no turns left ends at the root; an empty table gives no rows, not even
    a root. Other columns are ignored.
    """
    convs, rows = rebuilt(written(turns(conversations)), block, heads)
    convs = written(convs)
    trail = written(trails(convs, rows))
    inner = trail.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.first("words").alias("words"), F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"),
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), (F.sum("turns") + 1).alias("weight")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), "weight")
    nodes = written(inner.withColumn("depth", F.col("depth").cast("long")).unionByName(root))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes.select("node", "parent", "depth", "conv_id", "n_convs", "weight", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), saved))
    sums = written(rolled_up(nodes.select("node", "parent", "conv_id", "depth", "weight", "leaf", "saved"), trail.select("conv_id", "depth", "node", "parent")))
    last = trail.filter("depth = turns").select("node", "conv_id").unionByName(convs.filter("turns = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    ends = _ends(last)
    least = nodes.filter("n_children > 0 AND depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv"))
    top = nodes.filter("depth = 0").select("conv_id").first()
    out = nodes.join(sums, "node").join(ends, "node", "left").join(least, "parent", "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(top[0] if top else None).cast("long")).otherwise(F.col("parent_conv")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), sums["saved"].alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
