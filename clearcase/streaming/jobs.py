"""Streaming twins of the batch jobs; each has a batch counterpart that states its result.

Events arrive with an event time and a watermark; rows older than the watermark
are dropped by Spark.  Sinks are idempotent per batch id, so a batch replayed
after a failure overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clearcase import fixed_values as fv
from clearcase.operators import deid
from clearcase.operators import events as ev
from clearcase.operators import verify as vf
from clearcase.sources.tables import owned, settled

WIDTH_MS = fv.REQUEST_WINDOW_SECONDS * 1000
BREACH = "class STRING, key BIGINT, at_ms BIGINT, requests BIGINT, in_window BIGINT"
STATE = "times ARRAY<BIGINT>, counts ARRAY<BIGINT>"


def _trailing(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    """Trailing counts of one (class, key, minute), given when the watermark has passed the minute.

    Until then rows may still come in any order.  State holds one counter per
    millisecond of two minutes, so it is bounded however many requests a key sends.
    """
    if state.hasTimedOut:
        times, counts = (np.array(x, dtype="int64") for x in state.get)
        state.remove()
        upto = np.concatenate([[0], np.cumsum(counts)])
        own = np.flatnonzero(times // WIDTH_MS == int(key[2]))
        seen = upto[own + 1] - upto[np.searchsorted(times, times[own] - WIDTH_MS, side="left")]
        yield pd.DataFrame({"class": key[0], "key": key[1], "at_ms": times[own], "requests": counts[own], "in_window": seen})
        return
    new = np.concatenate([b["at_ms"].to_numpy("int64") for b in batches])
    times, counts = (np.array(x, dtype="int64") for x in state.get) if state.exists else (np.array([], "int64"), np.array([], "int64"))
    merged, where = np.unique(np.concatenate([times, new]), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([counts, np.ones(len(new))])).astype("int64")
    state.update((merged.tolist(), total.tolist()))
    state.setTimeoutTimestamp(max((int(key[2]) + 1) * WIDTH_MS, state.getCurrentWatermarkMs() + 1))


def limit_breaches(requests: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """Requests per class, key and millisecond with their trailing 60 s count, flagged past the budget.

    Needs columns at_ms, class, key.  As in batch, a request belongs to its minute and, as context, to the next, so a
    busy key spreads over its minutes.  A minute is given once the watermark has passed it, so rows that arrive out of
    order, but within ``delay``, count wherever they belong.
    """
    minute = F.floor(F.col("at_ms") / WIDTH_MS)
    slots = F.array(F.struct(minute.alias("m")), F.struct((minute + 1).alias("m")))
    placed = requests.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", delay).select("*", F.inline(slots))
    counted = placed.groupBy("class", "key", "m").applyInPandasWithState(_trailing, BREACH, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return counted.withColumn("breach", F.col("in_window") > ev.limit_of(F.col("class")))


class Trailing(StatefulProcessor):
    """The same counts with state of its own per (class, key, minute): counters of two minutes and one timer.

    The timer fires when the watermark has passed the minute; the counts then go out and the state is removed, so a key
    that falls silent leaves nothing behind.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", STATE)

    def _held(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.counters.exists():
            return np.zeros(0, "int64"), np.zeros(0, "int64")
        return tuple(np.array(x, dtype="int64") for x in self.counters.get())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([b["at_ms"].to_numpy("int64") for b in rows])
        times, counts = self._held()
        merged, where = np.unique(np.concatenate([times, new]), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([counts, np.ones(len(new))])).astype("int64")
        self.counters.update((merged.tolist(), total.tolist()))
        self.handle.registerTimer(max((int(key[2]) + 1) * WIDTH_MS, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        times, counts = self._held()
        if not len(times):  # another timer of this minute was first
            return
        self.counters.clear()
        upto = np.concatenate([[0], np.cumsum(counts)])
        own = np.flatnonzero(times // WIDTH_MS == int(key[2]))
        seen = upto[own + 1] - upto[np.searchsorted(times, times[own] - WIDTH_MS, side="left")]
        yield pd.DataFrame({"class": key[0], "key": key[1], "at_ms": times[own], "requests": counts[own], "in_window": seen})

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def limit_breaches_with_timers(requests: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """``limit_breaches`` by arbitrary state with timers; the session's state store must be RocksDB (``ROCKSDB``)."""
    minute = F.floor(F.col("at_ms") / WIDTH_MS)
    slots = F.array(F.struct(minute.alias("m")), F.struct((minute + 1).alias("m")))
    placed = requests.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", delay).select("*", F.inline(slots))
    counted = placed.groupBy("class", "key", "m").transformWithStateInPandas(Trailing(), BREACH, "append", "eventTime")
    return counted.withColumn("breach", F.col("in_window") > ev.limit_of(F.col("class")))


def sliding_counts(requests: DataFrame, delay: str = "2 minutes") -> DataFrame:
    timed = requests.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", delay)
    return ev.sliding_counts(timed)


def hourly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return ev.hourly_counts(events.withWatermark("ts", delay))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Per user session: first start, first success, first export."""
    first = lambda kind: F.min(F.when(F.col("event") == kind, F.col("ts")))
    timed = events.withWatermark("ts", delay)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(
        first("pa_generation_started").alias("started_at"), first("pa_generation_succeeded").alias("succeeded_at"),
        first("pa_exported").alias("exported_at"), F.count("*").alias("n"))


def without_repeats(events: DataFrame, *keys: str, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def event_log(events: DataFrame, path: str, checkpoint: str):
    """Append events to files partitioned by kind."""
    return (events.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("event")
            .outputMode("append").trigger(availableNow=True).start(path))


def metering(cases: DataFrame, path: str, checkpoint: str):
    """Counts per organization, surgeon and month; each batch writes its own partial sums."""
    def write(batch: DataFrame, batch_id: int) -> None:
        partial = batch.groupBy("org_id", "surgeon_id", F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))
        partial.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return cases.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metered(partials: DataFrame) -> DataFrame:
    return partials.groupBy("org_id", "surgeon_id", "period").agg(F.sum("n").alias("n"))


def phi_gate(texts: DataFrame, key: str, clean_path: str, quarantine_path: str, checkpoint: str, allow: list[str] | None = None):
    """Texts de-identified and verified per batch: clean text to one sink, leak reports to the other."""
    def write(batch: DataFrame, batch_id: int) -> None:
        with owned(batch.sparkSession):  # the token maps hold raw values
            checked = settled(vf.verified(settled(deid.deidentify(batch, "text", allow)), allow=allow))
            clean, report = vf.gate(checked, key)
            clean.write.mode("overwrite").parquet(f"{clean_path}/batch={batch_id}")
            report.write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
