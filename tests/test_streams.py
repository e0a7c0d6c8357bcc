"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from clearcase.bindings import bound
from clearcase.operators import events as ev
from clearcase.streaming import jobs


def as_stream(spark, df, folder, order, files=3):
    """``df`` as a file stream of ``files`` batches in event-time order."""
    path = str(folder / "in")
    n = max(df.count() // files + 1, 1)
    ranked = df.orderBy(order).toPandas()
    for i in range(files):
        part = ranked.iloc[i * n:(i + 1) * n]
        if len(part):
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collected(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def requests(spark, sf):
    # A stream's first watermark is the epoch, so rows at time 0 would be late.
    return bound(spark, sf, "requests").withColumn("at_ms", F.col("at_ms") + 86_400_000).cache()


def test_limit_breaches_of_rows_out_of_order(spark, requests, tmp_path):
    """Arrival is shuffled by up to 25 s, within the delay; a last row far ahead lets the watermark pass all others."""
    last = requests.agg(F.max("at_ms")).first()[0]
    closing = requests.limit(1).withColumn("at_ms", F.lit(last + 3_600_000).cast("bigint"))
    burst = requests.limit(1).drop("at_ms").crossJoin(spark.range(80).select((F.lit(last - 100_000) + F.col("id") * 1100).cast("bigint").alias("at_ms"))).select(*requests.columns)
    every = requests.unionByName(burst)
    shuffled = every.withColumn("arrives", F.col("at_ms") + F.pmod(F.xxhash64("event_id", "at_ms"), F.lit(25_000)))
    source = as_stream(spark, shuffled.unionByName(closing.withColumn("arrives", F.col("at_ms"))), tmp_path, "arrives", files=6)
    got = collected(spark, jobs.limit_breaches(source), "breaches").where(F.col("at_ms") <= last)
    want = ev.trailing_requests(every).groupBy("class", "key", "at_ms", "in_window", "breach").agg(F.count("*").alias("requests"))
    cols = ("class", "key", "at_ms", "requests", "in_window", "breach")
    assert rows(got, *cols) == rows(want, *cols)
    assert want.where("breach").count() > 0


def test_sliding_counts_match_up_to_the_watermark(spark, requests, tmp_path):
    got = collected(spark, jobs.sliding_counts(as_stream(spark, requests, tmp_path, "at_ms")), "sliding")
    want = {(str(r.w.start), r["class"], r.key): r.n for r in ev.sliding_counts(requests.withColumn("at", F.timestamp_millis("at_ms"))).collect()}
    seen = {(str(r.w.start), r["class"], r.key): r.n for r in got.collect()}
    assert seen and all(want[k] == n for k, n in seen.items())


def test_hourly_counts_sessions_and_repeats(spark, sf, tmp_path):
    events = bound(spark, sf, "product_events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = events.unionByName(events)
    stream = as_stream(spark, twice, tmp_path, "ts", 2)
    got = collected(spark, jobs.without_repeats(stream, "event_id"), "repeats")
    assert got.count() == events.count() == got.select("event_id").distinct().count()
    hourly = collected(spark, jobs.hourly_counts(spark.readStream.schema(twice.schema).parquet(str(tmp_path / "in"))), "hourly", "update")
    final = hourly.groupBy("w", "event", "stage").agg(F.max("n").alias("n"))
    assert rows(final.select(F.col("w.start").alias("s"), "event", "stage", "n"), "s", "event", "stage", "n") == rows(
        ev.hourly_counts(twice).select(F.col("w.start").alias("s"), "event", "stage", "n"), "s", "event", "stage", "n")
    closed = collected(spark, jobs.sessions(spark.readStream.schema(twice.schema).parquet(str(tmp_path / "in"))), "closed")
    assert closed.count() >= 0


def test_metering_and_event_log(spark, sf, tmp_path):
    cases = bound(spark, sf, "pa_cases").withColumn("created_at", F.col("created_at").cast("timestamp")).limit(900).cache()
    stream = as_stream(spark, cases, tmp_path, "created_at")
    q = jobs.metering(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    total = jobs.metered(spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")))
    assert total.agg(F.sum("n")).first()[0] == cases.count()
    events = bound(spark, sf, "product_events").select("event_id", "event").limit(200).cache()
    (tmp_path / "e").mkdir()
    log = jobs.event_log(as_stream(spark, events, tmp_path / "e", "event_id"), str(tmp_path / "log"), str(tmp_path / "ck2"))
    log.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == events.count()


def test_phi_gate(spark, tmp_path):
    texts = spark.createDataFrame([(1, "Seen on 3/24/2024 for pain."), (2, "call jdoe@example.com")], "id BIGINT, text STRING")
    stream = as_stream(spark, texts, tmp_path, "id", 1)
    q = jobs.phi_gate(stream, "id", str(tmp_path / "clean"), str(tmp_path / "bad"), str(tmp_path / "ck"), allow=["seen"])
    q.awaitTermination(240)
    assert q.exception() is None
    clean = {r.id: r.redacted for r in spark.read.parquet(str(tmp_path / "clean")).collect()}
    assert clean[1] == "Seen on [DATE_1] for pain." and clean[2] == "call [EMAIL_1]"


def test_breaches_by_timers_equal_batch_across_a_restart(spark, requests, tmp_path):
    """The stream stops after half of its files and goes on from its checkpoint; together it gives what batch gives."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, jobs.ROCKSDB)
    last = requests.agg(F.max("at_ms")).first()[0]
    closing = requests.limit(1).withColumn("at_ms", F.lit(last + 3_600_000).cast("bigint"))
    ordered = requests.unionByName(closing).orderBy("at_ms").toPandas()
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    half = len(ordered) // 2
    try:
        for part in (ordered.iloc[:half], ordered.iloc[half:]):
            spark.createDataFrame(part, requests.schema).coalesce(1).write.mode("append").parquet(folder)
            source = spark.readStream.schema(requests.schema).parquet(folder)
            q = jobs.limit_breaches_with_timers(source).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
            q.awaitTermination(240)
            assert q.exception() is None
    finally:
        spark.conf.set(name, before)
    got = spark.read.parquet(out).where(F.col("at_ms") <= last)
    want = ev.trailing_requests(requests).groupBy("class", "key", "at_ms", "in_window", "breach").agg(F.count("*").alias("requests"))
    cols = ("class", "key", "at_ms", "requests", "in_window", "breach")
    assert rows(got, *cols) == rows(want, *cols)
