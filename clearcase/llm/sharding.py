"""Sharding: indivisible groups into shards of near-equal bytes by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clearcase.llm.common import shuffle_width, written

SHARDS = 8
#: A group above 1/CUT of a shard is dealt into parts below that size; at most SHARDS * CUT groups can be that large.
CUT = 2
#: Indivisible bundles that a shard is made of in the last step, and single groups kept aside to even them out.
BUNDLES, FINE = 128, 2048


def differenced(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item by repeated differencing.

    Each partial partition holds ``shards`` sums with their items. The two of the largest spread are combined, the
    largest sum of one with the smallest of the other, until one is left. Item lists are trees, joined in one step.
    """
    heap = []
    for k, size in enumerate(sizes):
        heap.append((-size, k, [(0, None)] * (shards - 1) + [(size, k)]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted(
            ((x + y, (p, q) if p is not None and q is not None else (q if p is None else p)) for (x, p), (y, q) in zip(a, reversed(b))),
            key=lambda s: s[0],
        )
        low = both[0][0]
        if low:  # only differences matter
            both = [(x - low, p) for x, p in both]
        heapq.heappush(heap, (-both[-1][0], tick, both))
        tick += 1
    found = [0] * len(sizes)
    for shard, (_, root) in enumerate(heap[0][2] if heap else []):
        stack = [root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            elif node is not None:
                found[node] = shard
    return found


def sharded(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_crc32, size, shard, slot): every row in a shard, equal texts together, bytes near equal.

    Differencing in two levels. Each task differences its groups into bundles of about 1/BUNDLES of a shard; then the
    bundles, the groups larger than one, and a few single groups are differenced into the shards. That last step has
    about shards * BUNDLES + FINE items at any size of the input. Only a group larger than 1/CUT of a shard is split:
    its rows are dealt by a hash of the id.

    Size is UTF-8 bytes plus one (null: none; null texts and empty ones are groups of their own). Slots count from 0
    without gap in each shard. Repeated rows and null ids count each; an empty table gives an empty one.
    """
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    t = docs[text].cast("string")
    rows = written(docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(t.cast("binary")), F.lit("")).alias("key"),
    ))
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return rows.select("doc_id", "text_crc32", "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    limit, target = max(1, total // (shards * CUT)), max(1, total // (shards * BUNDLES))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    # At most shards * CUT keys can be above the limit, so this side is small at any size of the input.
    large = groups.filter(F.col("bytes") > limit).select("key", F.ceil(F.col("bytes") / limit).cast("long").alias("parts"))
    rows = rows.join(F.broadcast(large), "key", "left").withColumn(
        "part", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    ).drop("parts")
    items = rows.groupBy("key", "part").agg(F.sum("size").alias("size")).repartition(width, "key", "part")
    fine = max(1, FINE // width)

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's groups with the bundle of each."""
        held = list(batches)
        if not held:
            return
        held = pd.concat(held, ignore_index=True).sort_values(["key", "part"], ignore_index=True)  # by hash: at random
        alone = (held["size"] > target) | (held.index < fine)
        small = held.index[~alone]
        bins = max(1, round(int(held["size"][small].sum()) / target))
        bundle = held.index.to_numpy() + bins
        bundle[small] = differenced(held["size"][small].tolist(), bins)
        held["bundle"] = bundle + (TaskContext.get().partitionId() << 32)
        yield held

    dealt = written(items.mapInPandas(bundled, "key string, part long, size long, bundle long"))
    # About shards * BUNDLES + FINE rows and one per task and large group: bounded apart from the input.
    sums = sorted((r["bundle"], r["bytes"]) for r in dealt.groupBy("bundle").agg(F.sum("size").alias("bytes")).collect())
    found = differenced([size for _, size in sums], shards)
    places = spark.createDataFrame([(b, s) for (b, _), s in zip(sums, found)], "bundle long, shard int")
    assigned = dealt.join(F.broadcast(places), "bundle").select("key", "part", "shard")
    return numbered(written(rows.join(assigned, ["key", "part"]).select("doc_id", "text_crc32", "size", "shard")), "shard")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """A ``slot`` column, gapless from 0 within ``by``: counts per (value, bucket), then places within the bucket.

    ``rows`` must be a written table, as it is read twice. Buckets follow the shuffle width; offsets are one row each.
    """
    width = shuffle_width(rows.sparkSession)
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(4 * width)).cast("int"))
    counts = bucketed.groupBy(by, "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select(by, "bucket", (F.sum("n").over(W.partitionBy(by).orderBy("bucket")) - F.col("n")).alias("offset"))
    within = W.partitionBy(by, "bucket").orderBy("doc_id", "text_crc32")
    return (
        bucketed.join(F.broadcast(offsets), [by, "bucket"])
        .withColumn("slot", F.row_number().over(within) - 1 + F.col("offset"))
        .drop("bucket", "offset")
    )
