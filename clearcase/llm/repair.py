"""Damaged conversations repaired by cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearcase.llm import lattice
from clearcase.llm.common import shuffle_width, written
from clearcase.llm.trie import ranked

#: Turns and bytes of a conversation that one task repairs at once; longer ones go in segments of that many turns.
SEGMENT = 1000
SEGMENT_BYTES = 8_000_000
BLANKS = " \t\n\x0b\x0c\r"

SHORT = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
MOVE = "struct<entry:int,exit:int,cost:long,audit:string>"
SEGMENTS = f"conv_id long, segment long, blank long, duplicate long, truncated long, illegal long, begins string, ends string, moves array<{MOVE}>"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage by the unsigned CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes its
    role ``user``. A null role, text or turn counts as one blank; rows without a conv_id are left out.
    """
    key = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), key.alias("key"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("key") == 3, 2).otherwise(1)))
    changed = F.when(F.col("key") == 1, "").when(F.col("key") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("key <> 0").select("conv_id", "turn", F.when(F.col("key") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with what decides their faults, in ranks within their conversation."""
    bare: Column = F.rtrim("text", F.lit(BLANKS))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    fault = F.when(bare == "", lattice.BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), lattice.CUT_OFF).otherwise(lattice.CLEAN)
    rows = rows.withColumns({"digest": same, "fault": fault})
    return ranked(rows, "conv_id", F.col("turn").asc_nulls_first(), F.col("digest"))


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _counted(faults: list[int], kind: int) -> int:
    return sum(f == kind for f in faults)


def _groups(batches, key: list[str]) -> Iterator[dict[str, list]]:
    """Runs of rows with one key, as columns."""
    names: list[str] = []
    held: dict[str, list] = {}
    for batch in batches:
        names = batch.schema.names
        part = batch.to_pydict()
        for row in zip(*part.values()):
            now = dict(zip(names, row))
            if held and any(held[k][-1] != now[k] for k in key):
                yield held
                held = {}
            for n in names:
                held.setdefault(n, []).append(now[n])
    if held:
        yield held


def _lines(roles: list[str], texts: list[str], kept: list[tuple[int, str | None]]) -> list[str]:
    return [f"{role or roles[i]}:{texts[i] if i >= 0 else ''}" for i, role in kept]


def _whole(batches) -> Iterator[pa.RecordBatch]:
    """Conversations that fit a task."""
    done: list[dict] = []
    size = 0
    for g in _groups(batches, ["conv_id"]):
        seen: set[str] = set()
        faults = []
        for fault, digest in zip(g["fault"], g["digest"]):
            faults.append(lattice.DUPLICATE if fault != lattice.BLANK and digest in seen else fault)
            seen.add(digest)
        initials = [r[:1] for r in g["role"]]
        rows = list(zip(initials, faults))
        cost, audit = lattice.cheapest(rows, 0, [4 * len(rows) + s for s in lattice.ENDS], True)
        repaired = "\n".join(_lines(g["role"], g["text"], lattice.replayed(initials, audit, 0)))
        counts = [_counted(faults, k) for k in (lattice.BLANK, lattice.DUPLICATE, lattice.CUT_OFF)]
        done.append(dict(zip(_SHORT.names, [g["conv_id"][0], *counts, _illegal(initials), cost, audit, repaired])))
        size += len(repaired)
        if size > 4_000_000 or len(done) == 1000:
            yield pa.RecordBatch.from_pylist(done, _SHORT)
            done, size = [], 0
    if done:
        yield pa.RecordBatch.from_pylist(done, _SHORT)


_SHORT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.string())])
_MOVES = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int64()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("begins", pa.string()), ("ends", pa.string()), ("moves", _MOVES)]
)


def _searched(batches) -> Iterator[pa.RecordBatch]:
    """For each segment, the cheapest edits from every state before it to every state after its last turn."""
    for g in _groups(batches, ["conv_id", "segment"]):
        initials, faults = [r[:1] for r in g["role"]], g["fault"]
        rows = list(zip(initials, faults))
        last = g["rank"][-1] == g["turns"][0]
        moves = []
        for entry in range(4):
            for ends in ([lattice.ENDS] if last else [(q,) for q in range(4)]):
                found = lattice.cheapest(rows, entry, [4 * len(rows) + q for q in ends], last)
                if found:
                    moves.append({"entry": entry, "exit": -1 if last else ends[0], "cost": found[0], "audit": found[1]})
        counts = [_counted(faults, k) for k in (lattice.BLANK, lattice.DUPLICATE, lattice.CUT_OFF)]
        yield pa.RecordBatch.from_pylist([dict(zip(_SEGMENTS.names, [g["conv_id"][0], g["segment"][0], *counts, _illegal(initials), initials[0], initials[-1], moves]))], _SEGMENTS)


def _chosen(batches) -> Iterator[pa.RecordBatch]:
    """The moves that a conversation's segments take: least cost, then least audit.

    ``order`` ranks the audits of a segment that begin in one state. All of them end with the segment's last turn, so none
    begins with another, and the least first one that still leads to the least cost decides.
    """
    for g in _groups(batches, ["conv_id"]):
        many = len(g["segment"])
        rest = [{-1: 0}]
        for moves in reversed(g["moves"]):
            costs: dict[int, int] = {}
            for m in moves:
                if m["exit"] in rest[-1]:
                    costs[m["entry"]] = min(costs.get(m["entry"], 1 << 60), m["cost"] + rest[-1][m["exit"]])
            rest.append(costs)
        rest.reverse()
        state, taken = 0, []
        for k, moves in enumerate(g["moves"]):
            ways = [m for m in moves if m["entry"] == state and m["exit"] in rest[k + 1] and m["cost"] + rest[k + 1][m["exit"]] == rest[k][state]]
            way = min(ways, key=lambda m: m["order"])
            taken.append(way)
            state = way["exit"]
        crossed = [0, *(_illegal([a, b]) for a, b in zip(g["ends"], g["begins"][1:]))]
        yield pa.RecordBatch.from_pydict(
            {"conv_id": g["conv_id"], "segment": g["segment"], "entry": pa.array([w["entry"] for w in taken], pa.int32()), "exit": pa.array([w["exit"] for w in taken], pa.int32()),
             "crossed": pa.array(crossed[:many], pa.int64())}
        )


def _pieces(batches) -> Iterator[pa.RecordBatch]:
    """What each segment leaves, in pieces of some megabytes."""
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("piece", pa.int64()), ("repaired", pa.string())])
    for g in _groups(batches, ["conv_id", "segment"]):
        lines = _lines(g["role"], g["text"], lattice.replayed([r[:1] for r in g["role"]], g["audit"][0], g["entry"][0]))
        piece: list[str] = []
        size, number = 0, 0
        for line in [*lines, None]:
            if piece and (line is None or size > 4_000_000):
                yield pa.RecordBatch.from_pylist([{"conv_id": g["conv_id"][0], "segment": g["segment"][0], "piece": number, "repaired": "\n".join(piece)}], schema)
                piece, size, number = [], 0, number + 1
            if line is not None:
                piece.append(line)
                size += len(line)


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, sha256): of a conversation's pieces joined by new lines, which no task holds at once."""

    def hashed(batches):
        conv, state = None, None
        for batch in batches:
            done: dict[str, list] = {"conv_id": [], "sha256": []}
            for c, text in zip(batch.column("conv_id").to_pylist(), batch.column("repaired").to_pylist()):
                if c == conv:
                    state.update(b"\n" + text.encode())
                    continue
                if state:
                    done["conv_id"].append(conv), done["sha256"].append(state.hexdigest())
                conv, state = c, hashlib.sha256(text.encode())
            if done["conv_id"]:
                yield pa.RecordBatch.from_pydict(done)
        if state:
            yield pa.RecordBatch.from_pydict({"conv_id": [conv], "sha256": [state.hexdigest()]})

    return pieces.repartition(shuffle_width(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "segment", "piece").mapInArrow(hashed, "conv_id long, sha256 string")


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries and pieces of conversations that go in segments."""
    wide = shuffle_width(rows.sparkSession)
    rows = rows.withColumn("segment", F.floor((F.col("rank") - 1) / SEGMENT))
    again = rows.groupBy("conv_id", "digest").agg(F.min("rank").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    light = rows.select("conv_id", "segment", "rank", "turns", F.left("role", F.lit(1)).alias("role"), "digest", "fault").join(again, ["conv_id", "digest"], "left")
    fault = F.when((F.col("rank") > F.col("first")) & (F.col("fault") != lattice.BLANK), lattice.DUPLICATE).otherwise(F.col("fault"))
    light = light.select("conv_id", "segment", "rank", "turns", "role", fault.alias("fault"))
    segments = written(light.repartition(wide, "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "rank").mapInArrow(_searched, SEGMENTS))
    order = "transform(moves, m -> struct(m.entry, m.exit, m.cost, size(filter(moves, o -> o.entry = m.entry AND o.audit < m.audit)) AS order))"
    chosen = segments.select("conv_id", "segment", "begins", "ends", F.expr(order).alias("moves")).repartition(wide, "conv_id").sortWithinPartitions("conv_id", "segment")
    chosen = chosen.mapInArrow(_chosen, "conv_id long, segment long, entry int, exit int, crossed long")
    taken = written(segments.join(chosen, ["conv_id", "segment"]).withColumn("move", F.expr("filter(moves, m -> m.entry = entry AND m.exit = exit)[0]")).drop("moves"))
    parts = F.array_sort(F.collect_list(F.struct("segment", F.col("move.audit").alias("audit"))))
    sums = taken.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + F.col("crossed")).alias("illegal"), F.sum("move.cost").alias("cost"), parts.alias("parts"))
    audit = F.array_join(F.transform("parts", lambda p: p["audit"]), "")
    summary = sums.select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"), F.lit(None).cast("string").alias("repaired"))
    ways = taken.select("conv_id", "segment", "entry", F.col("move.audit").alias("audit"))
    lead = F.col("rank") == F.col("segment") * SEGMENT + 1
    told = rows.join(ways, ["conv_id", "segment"]).select("conv_id", "segment", "rank", "role", "text", "entry", F.when(lead, F.col("audit")).alias("audit"))
    pieces = told.repartition(wide, "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "rank").mapInArrow(_pieces, "conv_id long, segment long, piece long, repaired string")
    return summary, pieces


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries of the conversations in ``rows`` (conv_id, turn, role, text), and pieces of the long ones.

    A summary has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired: ``role:text`` lines, null
    for a conversation of more than ``SEGMENT`` turns or ``SEGMENT_BYTES``, whose lines are in the pieces (conv_id,
    segment, piece, repaired), to be joined by new lines in that order. Turns stand by ``turn`` (null first), equal ones by
    the SHA-256 of role and text. Roles and texts must not be null; a turn with an empty role cannot be kept, only
    reroled or deleted; a conversation of blank turns alone ends empty. An empty table gives empty ones.

    A conversation is searched in its edit lattice from both ends (``lattice.cheapest``). A longer one goes in segments:
    each is searched from all four states to all four, and the segments' costs are then chained.
    """
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    marked = written(_marked(rows))
    sizes = marked.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.octet_length("text")).alias("bytes"))
    long = written(sizes.filter((F.col("turns") > SEGMENT) | (F.col("bytes") > SEGMENT_BYTES)).drop("bytes"))
    some = long.limit(1).count() > 0
    short = marked.join(long, "conv_id", "left_anti") if some else marked
    short = short.select("conv_id", "rank", "role", "text", "digest", "fault").repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "rank")
    summary = short.mapInArrow(_whole, SHORT)
    pieces = rows.sparkSession.createDataFrame([], "conv_id long, segment long, piece long, repaired string")
    if some:
        more, pieces = _long(marked.join(long, "conv_id"))
        summary = summary.unionByName(more)
    return summary.join(gaps, "conv_id").withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))), pieces


def after_damage(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: its repair after ``damaged``, with ``repaired_sha256``.

    A conversation that damage leaves without rows has zeros, an empty audit and the hash of the empty string. Rows
    without a conv_id are left out; other columns are ignored.
    """
    summary, pieces = repaired(damaged(conversations))
    every = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long")).distinct()
    out = every.join(summary, "conv_id", "left").join(digests(pieces), "conv_id", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", *(F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce(F.sha2(F.col("repaired").cast("binary"), 256), "sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
