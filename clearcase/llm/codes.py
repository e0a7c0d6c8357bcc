"""Exact nearest codes by Hamming distance: multi-index hashing with growing segment radii."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clearcase.llm.common import written

BITS, NEIGHBOURS = 64, 10
#: Codes up to which segments have 8 bits; more codes get 16-bit segments. The results are the same.
FEW = 1 << 22


def sign_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, code): a 64-bit code of the signs of the first 64 components; null for vectors that are null or hold one."""
    v = vectors[embedding]
    bits = F.aggregate(
        F.transform(F.slice(v, 1, BITS), lambda x, i: F.when(x.isNull(), F.lit(None).cast("long")).when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b),
    )
    return vectors.select(vectors[vec_id].cast("long").alias("id"), F.when(v.isNotNull() & (F.size(v) > 0), bits).alias("code"))


def within(width: int, radius: int) -> Column:
    """All numbers of ``width`` bits with at most ``radius`` ones, as one constant array."""
    numbers = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in itertools.combinations(range(width), r)]
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def nearest(codes: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, neighbour_id, distance, rank): the ``k`` rows nearest to each query, ties by least id.

    Codes are cut into m segments, each with an index. If the first a + 1 segments are searched to radius s and the
    others to s - 1, every code within distance m * s + a has been met, since a farther one differs by more in each.
    Radii grow until a query has k codes inside that covered distance; whole segments cover every code. A round keeps
    only what its growth newly covers, and a pair counts in its first segment that met it, so nothing comes twice.

    Equal codes are one entry with its k + 1 least ids: of ids at one distance no others can be among the nearest.
    Rows with a null id or code have no neighbours and are none; equal rows count once; a query's own row is left out.
    With fewer than k others, a query has all of them. Empty tables give an empty one.
    """
    usable = codes.select("id", "code").filter("id IS NOT NULL AND code IS NOT NULL").distinct()
    ranked = usable.withColumn("r", F.row_number().over(W.partitionBy("code").orderBy("id"))).filter(F.col("r") <= k + 1)
    entries = written(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    kept, distinct = entries.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.count("*")).first()
    width = 8 if distinct <= FEW else 16
    segments = BITS // width
    part = lambda code, j: F.call_function("shiftrightunsigned", code, F.lit(j * width)).bitwiseAND(F.lit((1 << width) - 1))
    parts = lambda code: F.posexplode(F.array(*[part(code, j) for j in range(segments)]))
    index = written(entries.select("code", parts(F.col("code")).alias("segment", "value")))
    asked = written(queries.select("id", "code").filter("id IS NOT NULL AND code IS NOT NULL").distinct())
    left = written(asked.select("code").distinct())
    found, covered = None, -1
    # Whole steps while they cost little, then one segment at a time.
    steps = [(0, segments - 1), (1, segments - 1)] + [(s, a) for s in range(2, width + 1) for a in range(segments)]
    for radius, last in steps:
        reach = segments * radius + last
        radii = [radius if j <= last else radius - 1 for j in range(segments)]
        probes = None
        for r in sorted(set(radii)):
            own = left.select(F.col("code").alias("query"), parts(F.col("code")).alias("segment", "own")).filter(F.col("segment").isin([j for j in range(segments) if radii[j] == r]))
            some = own.withColumn("flip", F.explode(within(width, r))).select("query", "segment", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
            probes = some if probes is None else probes.unionByName(some)
        differ = F.col("query").bitwiseXOR(F.col("code"))
        apart = F.bit_count(differ)
        # The first segment whose difference is within its radius.
        meets = F.coalesce(*[F.when(F.bit_count(part(differ, j)) <= r, F.lit(j)) for j, r in enumerate(radii)])
        pairs = probes.join(index, ["segment", "value"]).filter((apart > covered) & (apart <= reach) & (meets == F.col("segment")))
        step = written(pairs.select("query", "code", apart.alias("distance")))
        found, covered = step if found is None else found.unionByName(step), reach
        counted = found.join(entries, "code").groupBy("query").agg(F.sum(F.size("ids")).alias("n"))
        done = counted.filter(F.col("n") >= min(k + 1, kept)).select(F.col("query").alias("code"))
        left = written(left.join(done, "code", "left_anti"))
        if not left.limit(1).count():
            break
    pairs = found.join(entries, "code").select("query", "code", "distance", F.explode("ids").alias("neighbour_id"))
    # Equal queries share their pairs; a query's nearest are ranked from at most a few times k rows.
    of = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(pairs, "query")
    of = of.filter((F.col("neighbour_id") != F.col("query_id")) | (F.col("code") != F.col("query")))
    order = W.partitionBy("query_id", "query").orderBy("distance", "neighbour_id")
    return of.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "neighbour_id", "distance", "rank")
