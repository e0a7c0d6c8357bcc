"""Bytes that repeat in long strings anywhere in the collection, removed from every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcase.llm import repeats
from clearcase.llm.common import text_slices, written

#: Strings of one anchor that one task compares; an anchor with more goes on with longer grams.
GROUP = 20_000
BATCH = 16_000
#: Keys that travel to every task; more are joined by a shuffle.
KEYS = 1_000_000

ANCHORS = "uid long, first long, starts int, before int, anchor long, f1 long, f2 long"
STRINGS = "anchor long, f1 long, f2 long, before int, starts int, string binary"
RUNS = "array<struct<low:int,high:int>>"


def grams(length: int) -> list[int]:
    """Anchor lengths by level; the last is the string itself, so that equal anchors are equal strings."""
    return sorted({max(1, length // 4), max(1, length * 5 // 8), length})


def _cut(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The anchored strings of texts (uid, text), without their bytes."""

    def found(batches):
        for batch in text_slices(batches):
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text")):
                whole = memoryview(text.as_buffer())
                if len(whole) < length:
                    continue
                for first, starts, before, anchor in repeats.anchors(np.frombuffer(whole, np.uint8), length, gram):
                    marks = [repeats.fingerprint(whole[a : a + n + length - 1]) for a, n in zip(first.tolist(), starts.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(first.size, uid)), pa.array(first), pa.array(starts.astype(np.int32)), pa.array(before.astype(np.int32)),
                         pa.array(anchor), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64())],
                        names=["uid", "first", "starts", "before", "anchor", "f1", "f2"],
                    )

    return texts.select("uid", "text").mapInArrow(found, ANCHORS)


def _fetched(rows: DataFrame, length: int) -> DataFrame:
    """The bytes of the strings listed beside each text."""

    def strings(batches):
        for batch in text_slices(batches):
            for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist()):
                whole = text.as_py()
                for low in range(0, len(wanted), 4096):
                    part = [w | {"string": whole[w["first"] : w["first"] + w["starts"] + length - 1]} for w in wanted[low : low + 4096]]
                    yield pa.RecordBatch.from_pylist(part, _STRINGS)

    return rows.mapInArrow(strings, STRINGS)


_STRINGS = pa.schema([("anchor", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("before", pa.int32()), ("starts", pa.int32()), ("string", pa.binary())])
_RUNS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
_MARKS = pa.schema([("anchor", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("runs", _RUNS)])


def _marks(rows: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated starts of whole groups of strings."""
    anchor = rows.column("anchor").to_numpy()
    groups = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
    starts = rows.column("starts").to_numpy()
    flags = repeats.repeated_starts(groups, rows.column("before").to_numpy().astype(np.int64), starts.astype(np.int64), rows.column("string").to_pylist(), length)
    edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    string, low = np.nonzero(edges == 1)
    high = np.nonzero(edges == -1)[1]
    some, at = np.unique(string, return_index=True)
    runs = pa.ListArray.from_arrays(pa.array(np.append(at, string.size), pa.int32()), pa.StructArray.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["low", "high"]))
    found = rows.select(["anchor", "f1", "f2"]).take(pa.array(some)).append_column("runs", runs.cast(_RUNS))
    yield from found.cast(_MARKS).to_batches()


def _compared(strings: DataFrame, length: int, tasks: int) -> DataFrame:
    """Groups of at most ``GROUP`` strings, column by column."""

    def compare(batches):
        held: list[pa.RecordBatch] = []
        many = 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            while many >= BATCH:
                rows = pa.Table.from_batches(held).combine_chunks()
                anchor = rows.column("anchor").to_numpy()
                border = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
                at = border[min(np.searchsorted(border, BATCH), border.size - 1)] if border.size else 0
                if not at:  # one group goes on: at most GROUP strings
                    break
                yield from _marks(rows.slice(0, at), length)
                held = rows.slice(at).combine_chunks().to_batches()
                many = rows.num_rows - at
        if held and many:
            yield from _marks(pa.Table.from_batches(held).combine_chunks(), length)

    return strings.repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(compare, f"anchor long, f1 long, f2 long, runs {RUNS}")


def _split(strings: DataFrame, length: int, gram: int) -> DataFrame:
    """Strings cut again at anchors of longer grams, beside the string (p1, p2) and the place they come from."""

    def cut(batches):
        for batch in text_slices(batches, "string"):
            for f1, f2, string in zip(batch.column("f1").to_pylist(), batch.column("f2").to_pylist(), batch.column("string").to_pylist()):
                for first, starts, before, anchor in repeats.anchors(np.frombuffer(string, np.uint8), length, gram):
                    parts = [string[a : a + n + length - 1] for a, n in zip(first.tolist(), starts.tolist())]
                    marks = [repeats.fingerprint(p) for p in parts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f1] * first.size, pa.int64()), pa.array([f2] * first.size, pa.int64()), pa.array(first.astype(np.int32)),
                         pa.array(anchor), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                         pa.array(before.astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(parts, pa.binary())],
                        names=["p1", "p2", "place", "anchor", "f1", "f2", "before", "starts", "string"],
                    )

    return strings.mapInArrow(cut, "p1 long, p2 long, place int, " + STRINGS)


def _repeated(strings: DataFrame, length: int, level: int) -> DataFrame:
    """(anchor, f1, f2, runs): the starts of distinct strings whose ``length`` bytes stand in another place too.

    A group of one string that stands in several places is repeated whole. Larger groups are compared, those above
    ``GROUP`` after another cut at longer grams; at the last level equal anchors are equal strings, so none is larger.
    """
    sizes = written(strings.groupBy("anchor").agg(F.count("*").alias("many")))
    hot = sizes.filter(F.col("many") > GROUP)
    total = sizes.agg(F.sum("many")).first()[0] or 0
    heavy = hot.limit(1).count() > 0
    small = strings.join(hot, "anchor", "left_anti") if heavy else strings
    marks = _compared(small.select("anchor", "f1", "f2", "before", "starts", "string"), length, max(1, -(-total // BATCH)))
    if not heavy:
        return marks
    large = strings.join(hot.select("anchor"), "anchor", "left_semi")
    parts = written(_split(large.select("f1", "f2", "string"), length, grams(length)[level + 1]))
    again = parts.groupBy("anchor", "f1", "f2").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("starts").alias("starts"), F.first("string").alias("string"))
    again = written(again)
    whole = again.filter("n > 1").select("anchor", "f1", "f2", F.expr(f"cast(array(struct(0 as low, starts as high)) as {RUNS})").alias("runs"))
    alone = _repeated(again.select("anchor", "f1", "f2", "before", "starts", "string"), length, level + 1) if level + 2 < len(grams(length)) else None
    deep = whole if alone is None else whole.unionByName(alone)
    back = parts.select("p1", "p2", "place", "anchor", "f1", "f2").join(deep, ["anchor", "f1", "f2"])
    moved = back.select("p1", "p2", F.explode(F.expr("transform(runs, r -> struct(r.low + place as low, r.high + place as high))")).alias("run"))
    found = moved.groupBy(F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.collect_list("run").alias("runs"))
    return marks.unionByName(large.select("anchor", "f1", "f2").join(found, ["f1", "f2"]).select("anchor", "f1", "f2", "runs"))


def _kept(rows: DataFrame, length: int) -> DataFrame:
    def removed(batches):
        for batch in text_slices(batches):
            kept, spans = [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs")):
                flat = runs.values.flatten()
                low, high = repeats.merged(flat[0].to_numpy(), flat[1].to_numpy() + length - 1)
                spans.append([{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist())])
                edges = [0, *(x for pair in zip(low.tolist(), high.tolist()) for x in pair), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in batch.column("text").to_pylist()], pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_bytes", "kept", "spans"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "runs").mapInArrow(removed, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def _with_keys(texts: DataFrame, keys: DataFrame, few: bool, how: str) -> DataFrame:
    return texts.join(F.broadcast(keys) if few else keys, "uid", how)


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes left), spans (of the bytes removed) for every row of ``docs`` (doc_id, text).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another;
    strings overlap and are judged on the texts as given. A null or empty text has no bytes and no spans; a text shorter
    than ``length`` stays whole; repeated rows and equal texts repeat each other, so that of two equal long texts nothing
    stays; a null doc_id is kept as it is; an empty table gives an empty one. Other columns are ignored.

    Texts are cut at anchors, which equal strings share: one pass lists them with 128-bit fingerprints of the strings
    around. Anchors that occur once are done, and those whose strings are all equal are repeated whole. Only the rest, once
    per distinct string, fetch their bytes, and are compared column by column (``repeats.repeated_starts``).
    """
    texts = written(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")))
    cut = written(_cut(texts, length, grams(length)[0]))
    shared = written(
        cut.groupBy("anchor").agg(F.count("*").alias("n"), F.min("f1").alias("a"), F.max("f1").alias("b"), F.min("f2").alias("c"), F.max("f2").alias("d"))
        .filter("n > 1").select("anchor", F.expr("a = b AND c = d").alias("alike"))
    )
    hits = written(cut.join(shared, "anchor"))
    wanted = written(
        hits.filter("NOT alike").groupBy("anchor", "f1", "f2")
        .agg(F.count("*").alias("n"), F.min(F.struct("uid", "first", "starts", "before")).alias("at"))
        .select("anchor", "f1", "f2", "n", "at.uid", "at.first", "at.starts", "at.before")
    )
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("anchor", "f1", "f2", "before", "starts", "first")).alias("wanted"))
    places = written(wanted.select("uid").distinct())
    picked = _with_keys(texts.select("uid", "text"), places, places.count() <= KEYS, "left_semi")
    strings = written(_fetched(picked.join(lists.hint("merge"), "uid"), length))
    marks = written(_repeated(strings, length, 0))
    whole = F.expr(f"cast(array(struct(0 as low, starts as high)) as {RUNS})")
    once = wanted.filter("n = 1").select("anchor", "f1", "f2")
    known = written(marks.join(once, ["anchor", "f1", "f2"]).unionByName(wanted.filter("n > 1").select("anchor", "f1", "f2", whole.alias("runs"))))
    runs = hits.filter("alike").select("uid", "first", whole.alias("runs")).unionByName(
        hits.filter("NOT alike").join(known, ["anchor", "f1", "f2"]).select("uid", "first", "runs")
    )
    placed = runs.select("uid", F.explode(F.expr("transform(runs, r -> struct(r.low + first as low, r.high + first as high))")).alias("run"))
    spans = written(placed.groupBy("uid").agg(F.collect_list("run").alias("runs")))
    keys = spans.select("uid")
    few = keys.count() <= KEYS
    touched = _with_keys(texts, keys, few, "left_semi").join(spans.hint("merge"), "uid")
    untouched = _with_keys(texts, keys, few, "left_anti").select(
        "doc_id", F.length("text").cast("long").alias("n_bytes"), F.col("text").alias("kept"), F.expr("cast(array() AS array<struct<start:long,end:long>>)").alias("spans")
    )
    return untouched.unionByName(_kept(touched, length))
