"""Usage metering and billing: all organizations in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcase import fixed_values as fv
from clearcase.sources.tables import settled


def month_of(ts: Column | str) -> Column:
    return F.date_trunc("month", ts)


def in_period(ts: Column | str, start: str, end: str) -> Column:
    """Half-open [start, end); on a stored column this reaches the scan as a pushed filter."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))


def group_price_cents(active_surgeons: Column) -> Column:
    return (F.lit(fv.GROUP_BASE_PRICE) + F.lit(fv.GROUP_PRICE_PER_SURGEON) * active_surgeons) * 100


def surgeon_usage(surgeons: DataFrame, cases: DataFrame) -> DataFrame:
    """Every surgeon with their case count, 0 where there is none.

    Counting first leaves one row per surgeon before the join, so a surgeon
    with a third of all cases costs one partial sum per task, not one hot task.
    """
    counts = cases.groupBy("surgeon_id").agg(F.count("*").alias("n"))
    return surgeons.join(counts, surgeons.id == counts.surgeon_id, "left").select(
        "org_id", surgeons.id.alias("surgeon_id"), "full_name",
        F.coalesce("active", F.lit(False)).alias("active"),
        F.coalesce("n", F.lit(0)).alias("case_count"),
    )


def billing_for_period(organizations: DataFrame, surgeons: DataFrame, cases: DataFrame, start: str, end: str) -> DataFrame:
    """One bill per organization; totals include inactive surgeons, the amount does not."""
    usage = surgeon_usage(surgeons, cases.where(in_period("created_at", start, end)).select("surgeon_id"))
    per_org = usage.groupBy("org_id").agg(
        F.count_if("active").alias("active_surgeons"), F.sum("case_count").alias("total_cases")
    )
    return organizations.join(per_org, organizations.id == per_org.org_id, "left").select(
        organizations.id.alias("org_id"),
        "last_acknowledged_surgeon_count",
        F.coalesce("active_surgeons", F.lit(0)).alias("active_surgeons"),
        F.coalesce("total_cases", F.lit(0)).alias("total_cases"),
        group_price_cents(F.coalesce("active_surgeons", F.lit(0))).alias("amount_cents"),
    )


def billing_by_month(surgeons: DataFrame, cases: DataFrame) -> DataFrame:
    """Bills of every month that has cases, for every organization with surgeons."""
    monthly = cases.groupBy("surgeon_id", month_of("created_at").alias("month")).agg(F.count("*").alias("n"))
    roster = surgeons.groupBy("org_id").agg(F.count_if("active").alias("active_surgeons"))
    usage = monthly.join(surgeons.select(F.col("id").alias("surgeon_id"), "org_id"), "surgeon_id")
    totals = usage.groupBy("org_id", "month").agg(F.sum("n").alias("total_cases"))
    return totals.join(roster, "org_id").select(
        "org_id", F.date_format("month", "yyyy-MM").alias("month"), "active_surgeons", "total_cases",
        group_price_cents(F.col("active_surgeons")).alias("amount_cents"),
    )


def billing_drift(bills: DataFrame) -> DataFrame:
    """Organizations whose acknowledged surgeon count is not the billed one (null counts as drift)."""
    return bills.where(~F.col("last_acknowledged_surgeon_count").eqNullSafe(F.col("active_surgeons")))


def position_by_time(rows: DataFrame, at: str, bucket: int) -> DataFrame:
    """Signup position: how many rows have ``at`` <= mine; ties share the larger number.

    Three small steps instead of one unpartitioned window: equal times collapse
    to one row with a count, a running sum runs inside each time bucket, and
    bucket totals (bounded by the calendar, not by the rows) give the offset.
    """
    per_time = rows.groupBy(at).agg(F.count("*").alias("n")).withColumn("bucket", F.floor(F.col(at) / bucket))
    inside = Window.partitionBy("bucket").orderBy(at)
    running = per_time.withColumn("inside", F.sum("n").over(inside))
    totals = per_time.groupBy("bucket").agg(F.sum("n").alias("bucket_n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("offset"))
    positions = running.join(offsets, "bucket").select(at, (F.col("inside") + F.col("offset")).alias("position"))
    return rows.join(positions, at)


def send_batches(emails: DataFrame, key: str, size: int = fv.EMAIL_BATCH) -> DataFrame:
    """Batch numbers of ``size`` consecutive rows in ``key`` order, for keys of any type that sorts.

    Rows are dealt into ranges of the key and written, since ranges are cut by sampling; counts per range give each
    range its offset, and each is numbered on its own.
    """
    ranges = int(emails.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(emails.repartitionByRange(ranges, key).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("range").orderBy(key)))
    return ranked.join(F.broadcast(offsets), "range").withColumn(
        "batch", F.floor((F.col("offset") + F.col("rn") - 1) / size)
    ).drop("range", "rn", "offset")
