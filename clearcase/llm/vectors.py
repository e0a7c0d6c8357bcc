"""Near-duplicate vectors: a pigeonhole join over blocks of rotated coordinates."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcase.llm.common import shuffles_removed, written
from clearcase.llm.components import components

COSINE = 0.95
#: Coordinates of a block, rows of one side of a comparison, and rows that are compared with all that come near.
BLOCK, TILE, LEAF = 8, 20_000, 48
#: Vectors from whose medians the cells are cut (balance only; results do not depend on it), and rows of a cell.
SAMPLE, CELL = 20_000, 5_000
#: Copies a vector that a round may put on disk on average, and copies that are few enough for one round anyway.
ROUND, LEAST = 8, 250_000
#: Room for rounding in block distances; links themselves are decided on the whole vectors.
SLACK = 1e-9


@functools.cache
def rotation(size: int) -> np.ndarray:
    """A fixed random rotation: it spreads what vectors differ in evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(5).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def blocks_of(size: int) -> list[slice]:
    return [slice(k, min(k + BLOCK, size)) for k in range(0, size, BLOCK)]


def budgets(size: int, cosine: float) -> list[float]:
    """Each block's share, by its coordinates, of the squared distance that unit vectors at ``cosine`` have."""
    return [(2 - 2 * cosine) * (b.stop - b.start) / size + SLACK for b in blocks_of(size)]


def unit(packed: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors in double precision, a row per packed one; all of one length."""
    data = np.frombuffer(b"".join(packed.to_pylist()), dtype=kind).reshape(len(packed), -1).astype(np.float64)
    # Scaled first: squares of very large and very small components have no double.
    data = data / np.abs(data).max(axis=1)[:, None]
    return data / np.linalg.norm(data, axis=1)[:, None]


def divided(points: np.ndarray, most: int) -> tuple | None:
    """A tree of (coordinate, border, below, above) over ``points`` with about ``most`` in a leaf (None)."""
    if len(points) <= most:
        return None
    axis = int(points.var(axis=0).argmax())
    at = float(np.median(points[:, axis]))
    low = points[:, axis] <= at
    if low.all() or not low.any():
        return None
    return axis, at, divided(points[low], most), divided(points[~low], most)


def sides(y: np.ndarray, rows: np.ndarray, gaps: np.ndarray, axis: int, at: float, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, gaps) of what may come within ``limit`` of points below the border, then of those above it.

    ``gaps`` holds how far each row lies outside of the cell in each coordinate; their squares must fit into ``limit``.
    """
    over = y[rows, axis] - at
    for away in (np.maximum(over, 0), np.maximum(-over, 0)):
        wider = gaps.copy()
        wider[:, axis] = np.maximum(wider[:, axis], away)
        fit = (wider**2).sum(axis=1) <= limit
        yield rows[fit], wider[fit]


def visits(tree: tuple | None, y: np.ndarray, limit: float, part: int = 0, depth: int = 0) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, cell, home) for the cells of a tree that the ball around each row touches; a row is at home in one.

    ``part`` of 2**``depth`` holds the cells below one node of that depth; a cell above that depth is in the first part under it.
    """
    pile = [(tree, 1, np.arange(len(y)), np.zeros(y.shape), np.ones(len(y), bool))]
    while pile:
        node, number, rows, gaps, home = pile.pop()
        above = depth + 1 - number.bit_length()
        if not len(rows) or (above >= 0 and (number != (1 << depth | part) >> above or (node is None and part & ((1 << above) - 1)))):
            continue
        if node is None:
            yield rows, number, home[rows]
            continue
        axis, at, *below = node
        low = y[:, axis] <= at
        for k, (inside, wider) in enumerate(sides(y, rows, gaps, axis, at, limit)):
            pile.append((below[k], 2 * number + k, inside, wider, home & (low if k == 0 else ~low)))


def rounds_of(copies: dict[int, int], rows: int) -> list[tuple[int, int, int] | None]:
    """The (block, part, depth) of each round, so that one has about ``ROUND`` copies a row; None: all in one."""
    most = max(ROUND * rows, LEAST)
    if sum(copies.values()) <= most:
        return [None]
    depths = {k: max(0, math.ceil(math.log2(n / most))) for k, n in copies.items()}
    return [(k, part, depth) for k, depth in sorted(depths.items()) for part in range(1 << depth)]


def neighbours(x: np.ndarray, y: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) in which all pairs within ``limit`` stand: x is halved again and again, y goes where it may."""
    pile = [(np.arange(len(x)), np.arange(len(y)), np.zeros(y.shape))]
    while pile:
        h, g, gaps = pile.pop()
        if not len(h) or not len(g):
            continue
        axis = int(x[h].var(axis=0).argmax())
        at = np.median(x[h, axis])
        low = x[h, axis] <= at
        if len(h) <= LEAF or low.all():
            for start in range(0, len(h), 256):
                yield h[start : start + 256], g
            continue
        (below, g_below), (above, g_above) = sides(y, g, gaps, axis, at, limit)
        pile += [(h[low], below, g_below), (h[~low], above, g_above)]


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row, links being all pairs with at least ``cosine``.

    If two unit vectors are within the squared distance of ``cosine``, then in some block of rotated coordinates they
    are within that block's share of it. Each block is a range join: rows at home in a cell meet the rows whose ball
    touches it, in tiles of bounded size that are halved further inside, and what is within the block's budget is compared
    whole. Cells are cut at the medians of a bounded sample, coordinate by coordinate. A pair counts in the first block
    that finds it, so tiles return counts and spanning links, never pairs. Equal vectors are one class, compared once
    and counted by its size. Components keep their own type; a cosine is worked out in double precision.

    Null vectors, zero ones and ones with null or non-finite components link with nothing, as do vectors of different
    lengths. Repeated rows are vectors of their own; a null id has no component. Labels and other columns are not read.
    """
    spark = vectors.sparkSession
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    kind, name = ("<f4", "float") if single else ("<f8", "double")
    v = vectors[embedding].cast(f"array<{name}>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), F.when(usable, v).alias("v")).withColumn(
        # Adding zero makes minus zero equal to zero.
        "key", F.when(F.col("v").isNotNull(), F.md5(F.to_csv(F.struct(F.transform("v", lambda x: x + F.lit(0.0).cast(name)).cast("string"))).cast("binary")))
    )
    rows = written(rows)
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = classes.withColumn("class", F.xxhash64("key"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            ends, data = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(kind)
            parts = [data[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "class", "id", "n")), pa.array(parts, pa.binary())], names=["key", "class", "id", "n", "v"])

    classes = written(classes.mapInArrow(packed, "key string, class long, id long, n long, v binary"))
    total = classes.count()
    share = min(1.0, SAMPLE / max(1, total))
    some = classes.filter(F.pmod(F.xxhash64("class"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(2 * SAMPLE).toArrow().column("v").combine_chunks()
    width = np.dtype(kind).itemsize
    trees = {}
    lengths = np.array([len(x) // width for x in some.to_pylist()])
    for size in np.unique(lengths).tolist():
        turned = unit(some.filter(pa.array(lengths == size)), kind) @ rotation(size)
        trees[size] = [divided(turned[:, cut], max(64, int(CELL * share))) for cut in blocks_of(size)]

    def cells(batch: pa.RecordBatch, only: tuple[int, int, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """(rows, cell codes, block, home) of a batch's visits; ``only`` those of one (block, part, depth)."""
        sizes = np.array([len(x) // width for x in batch.column("v").to_pylist()])
        for size in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == size)
            turned = unit(batch.column("v").take(pa.array(of)), kind) @ rotation(size)
            for k, (cut, budget) in enumerate(zip(blocks_of(size), budgets(size, cosine))):
                if only and only[0] != k:
                    continue
                for near, cell, home in visits(trees[size][k] if size in trees else None, turned[:, cut], budget + SLACK, *(only or (0, 0, 0))[1:]):
                    yield of[near], np.full(len(near), ((size * 4096 + k) * 1_000_003 + cell) % (1 << 62), np.int64), k, home

    def celled(batches: Iterator[pa.RecordBatch], only: tuple[int, int, int] | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, code, k, home in cells(batch, only):
                taken = batch.take(pa.array(rows_))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code), pa.array([k] * len(code), pa.int32()), pa.array(home), *(taken.column(c) for c in ("class", "id", "n", "v"))],
                    names=["cell", "block", "home", "class", "id", "n", "v"],
                )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, code, k, _ in cells(batch):
                found_, m = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(m), pa.int32()), pa.array(found_), pa.array(m)], names=["block", "cell", "m"])

    visited = written(classes.mapInArrow(counted, "block int, cell long, m long").groupBy("block", "cell").agg(F.sum("m").alias("m")))
    # Only cells that the sample's medians left too full.
    full = visited.filter(F.col("m") > TILE).select("cell", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    copies = F.col("m") * F.coalesce(F.ceil(F.col("m") / TILE), F.lit(1))
    per_block = {r["block"]: r["copies"] for r in visited.groupBy("block").agg(F.sum(copies).alias("copies")).collect()}

    def tiles_of(only: tuple[int, int, int] | None) -> DataFrame:
        # Rows are made where they are needed: vectors are not written once for every cell.
        seen = classes.mapInArrow(lambda batches: celled(batches, only), "cell long, block int, home boolean, class long, id long, n long, v binary")
        tiled = seen.join(full, "cell", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        own = F.pmod(F.col("class"), F.col("tiles")).cast("int")
        every = F.sequence(F.lit(0), F.col("tiles") - 1)
        # A home row stands in one row of tiles, and every row, as a visitor, in one column.
        stands = F.array(*[
            F.struct(F.lit(False).alias("visitor"), own.alias("row"), F.lit(None).cast("int").alias("column")),
            F.struct(F.lit(True).alias("visitor"), F.lit(None).cast("int").alias("row"), own.alias("column")),
        ])
        placed = tiled.withColumn("stand", F.explode(F.when(F.col("home"), stands).otherwise(F.slice(stands, 2, 1)))).withColumn("other", F.explode(every))
        return placed.select(
            "cell", F.coalesce("stand.row", "other").alias("row"), F.coalesce("stand.column", "other").alias("column"), "block", "class", "id", "n", "v", F.col("stand.visitor").alias("visitor")
        )

    def compared(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        k, packed_all = tile["block"][0].as_py(), tile["v"].combine_chunks()
        vectors_ = unit(packed_all, kind)
        turned = vectors_ @ rotation(vectors_.shape[1])
        ids, counts, keys = tile["id"].to_numpy(), tile["n"].to_numpy(), tile["class"].to_numpy()
        visitor = tile["visitor"].to_numpy()
        h, g = np.flatnonzero(~visitor), np.flatnonzero(visitor)
        cuts, limits = blocks_of(vectors_.shape[1]), budgets(vectors_.shape[1], cosine)
        x, y = turned[h][:, cuts[k]], turned[g][:, cuts[k]]
        linked = {}
        parent = {}

        def root(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        least = dict(zip(keys.tolist(), ids.tolist()))
        xx, yy = (x**2).sum(1), (y**2).sum(1)
        for part, others in neighbours(x, y, limits[k] + SLACK):
            near = xx[part][:, None] + yy[others][None, :] - 2 * x[part] @ y[others].T <= limits[k] + SLACK
            i, j = np.nonzero(near)
            i, j = h[part[i]], g[others[j]]
            keep = keys[i] < keys[j]
            i, j = i[keep], j[keep]
            for at in range(0, len(i), 20_000):
                p, q = i[at : at + 20_000], j[at : at + 20_000]
                yes = (vectors_[p] * vectors_[q]).sum(1) >= cosine
                p, q = p[yes], q[yes]
                gap = (turned[p] - turned[q]) ** 2
                first = gap[:, cuts[k]].sum(1) <= limits[k]
                for cut, limit in zip(cuts[:k], limits[:k]):
                    first &= gap[:, cut].sum(1) > limit
                p, q = p[first], q[first]
                for a, b, na, nb in zip(keys[p].tolist(), keys[q].tolist(), counts[p].tolist(), counts[q].tolist()):
                    linked[a] = linked.get(a, 0) + nb
                    linked[b] = linked.get(b, 0) + na
                    ra, rb = root(a), root(b)
                    if ra != rb:
                        parent[rb] = ra
        names = list(linked)
        return pa.table({"class": pa.array(names, pa.int64()), "links": pa.array([linked[n] for n in names], pa.int64()),
                         "id": pa.array([least[n] for n in names], pa.int64()), "to": pa.array([least[root(n)] for n in names], pa.int64())})

    # Copies grow faster than the vectors, so they are made and compared in rounds, and those of a round are gone before the next.
    with shuffles_removed(spark):
        rounds = [written(tiles_of(only).groupBy("cell", "row", "column").applyInArrow(compared, "class long, links long, id long, to long")) for only in rounds_of(per_block, total)]
    found = functools.reduce(DataFrame.unionByName, rounds)
    labels = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    result = (
        classes.select("key", "class", "id", "n").join(links, "class", "left").join(labels, "id", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    joined = rows.select("vec_id", "key").join(result, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
