"""Product events and request logs: counts, funnels, trailing-window limits."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcase import fixed_values as fv

PROPS = "payer STRING, cpt_code STRING, duration_ms BIGINT, hard_block_count BIGINT, stage STRING, leak_count BIGINT"


SALTS = 16


def with_props(events: DataFrame) -> DataFrame:
    return events.withColumn("p", F.from_json("props", PROPS))


def limit_of(class_col: Column) -> Column:
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in fv.REQUEST_LIMITS.items())
    return F.create_map(*pairs)[class_col]


def trailing_requests(requests: DataFrame) -> DataFrame:
    """Requests of the last 60 s per (class, key), and whether the budget is exceeded.

    A trailing window of an event reaches only its own minute and the one
    before.  Requests are first counted per millisecond, so that a minute of a
    key is 60,000 rows at most, however many requests it sends; each count is
    placed in its minute and, as context, in the next one, and the window runs
    per (class, key, minute).  The counts join back to the requests.
    """
    width = fv.REQUEST_WINDOW_SECONDS * 1000
    minute = F.floor(F.col("at_ms") / width)
    counts = requests.groupBy("class", "key", "at_ms").agg(F.count("*").alias("n"))
    placed = counts.select(
        "*", F.explode(F.array(F.struct(minute.alias("m"), F.lit(True).alias("own")),
                               F.struct((minute + 1).alias("m"), F.lit(False).alias("own")))).alias("slot")
    )
    trail = Window.partitionBy("class", "key", "slot.m").orderBy("at_ms").rangeBetween(-width, 0)
    summed = placed.withColumn("in_window", F.sum("n").over(trail)).where("slot.own").select("class", "key", "at_ms", "in_window")
    return requests.join(summed, ["class", "key", "at_ms"]).withColumn("breach", F.col("in_window") > limit_of(F.col("class")))


def sliding_counts(requests: DataFrame, at: str = "at") -> DataFrame:
    """Requests per class and key in 60 s windows that start every 10 s; works on streams too."""
    return requests.groupBy(F.window(at, "60 seconds", "10 seconds").alias("w"), "class", "key").agg(F.count("*").alias("n"))


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events per hour and kind, failures by stage."""
    stage = F.when(F.col("event") == "pa_generation_failed", F.get_json_object("props", "$.stage")).otherwise("-")
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event", stage.alias("stage")).agg(F.count("*").alias("n"))


def latency_by_payer(events: DataFrame) -> DataFrame:
    """Duration and hard-block statistics of successful generations.

    The exact percentile keeps one counter per distinct millisecond, and the
    280 s request deadline bounds those, so its state does not grow with rows.
    """
    done = with_props(events.where(F.col("event") == "pa_generation_succeeded").select("event", "props"))
    return done.groupBy(F.col("p.payer").alias("payer")).agg(
        F.count("*").alias("n"),
        F.round(F.avg("p.duration_ms"), 3).alias("avg_ms"),
        F.round(F.percentile("p.duration_ms", F.lit(0.5)), 3).alias("median_ms"),
        F.round(F.avg("p.hard_block_count"), 6).alias("avg_hard_blocks"),
        F.count_if(F.col("p.hard_block_count") > 0).alias("blocked"),
    )


def latency_quantiles(events: DataFrame, quantiles: list[float], k: int = 400) -> DataFrame:
    """(payer, n, quantile, value, low, high, within): duration quantiles from KLL sketches, checked against true ranks.

    A sketch has some thousand values at most, however many rows it saw, and tasks merge theirs, so neither state nor
    shuffle follows the rows or the range of values. ``low`` and ``high`` are the shares of durations below the value and
    up to it; ``within`` says that the quantile is no more than 0.01 off.
    """
    done = with_props(events.where(F.col("event") == "pa_generation_succeeded").select("event", "props")).select("p.payer", "p.duration_ms")
    sketches = done.groupBy("payer").agg(F.kll_sketch_agg_bigint("duration_ms", F.lit(k)).alias("sketch"), F.count("duration_ms").alias("n"))
    values = [F.struct(F.lit(q).alias("quantile"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias("value")) for q in quantiles]
    asked = sketches.where("n > 0").select("payer", "n", F.array(*values).alias("asked"))
    # One row per payer with an array travels, so each duration is compared with its payer's values in place.
    met = done.join(asked, done["payer"].eqNullSafe(asked["payer"])).drop(asked["payer"])
    counts = [f for i in range(len(quantiles)) for f in (
        F.count_if(F.col("duration_ms") < F.col("asked")[i]["value"]).alias(f"b{i}"), F.count_if(F.col("duration_ms") <= F.col("asked")[i]["value"]).alias(f"u{i}"))]
    ranked = met.groupBy("payer").agg(F.first("n").alias("n"), F.first("asked").alias("asked"), *counts)
    rows = F.array(*[F.struct(F.col("asked")[i]["quantile"].alias("quantile"), F.col("asked")[i]["value"].alias("value"), (F.col(f"b{i}") / F.col("n")).alias("low"),
                              (F.col(f"u{i}") / F.col("n")).alias("high")) for i in range(len(quantiles))])
    told = ranked.select("payer", "n", F.inline(rows))
    return told.withColumn("within", (F.col("low") - 0.01 <= F.col("quantile")) & (F.col("quantile") <= F.col("high") + 0.01))


def funnel(events: DataFrame) -> DataFrame:
    """Per user: first start, first success after it, first export after that.

    Equal (user, kind, time) are one row, and a step keeps, map-side, the least
    time per user that is late enough.  The one-row-per-user table meets the
    events salted, so that a user with a third of all events is dealt out.
    """
    kinds = ("pa_generation_started", "pa_generation_succeeded", "pa_exported")
    times = events.where(F.col("event").isin(*kinds)).select("user_id", "event", "ts").distinct()
    salt = F.pmod(F.xxhash64("ts"), F.lit(SALTS)).cast("int")
    of = lambda kind: times.where(F.col("event") == kind).select("user_id", "ts")

    def first_after(kind: str, prior: DataFrame, at: str, out: str) -> DataFrame:
        known = prior.where(F.col(at).isNotNull()).select("user_id", at, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        later = of(kind).withColumn("salt", salt).join(known, ["user_id", "salt"]).where(F.col("ts") >= F.col(at))
        return prior.join(later.groupBy("user_id").agg(F.min("ts").alias(out)), "user_id", "left")

    started = of("pa_generation_started").groupBy("user_id").agg(F.min("ts").alias("started_at"))
    succeeded = first_after("pa_generation_succeeded", started, "started_at", "succeeded_at")
    return first_after("pa_exported", succeeded, "succeeded_at", "exported_at")


def first_occurrences(events: DataFrame, *keys: str) -> DataFrame:
    """Duplicate suppression: the earliest event per key, by map-side min."""
    return events.groupBy(*keys).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
