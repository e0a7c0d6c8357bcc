"""A stored table with a key: rows in hash buckets, of which an update rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearcase.sources.tables import settled

BUCKET = "bucket"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _latest(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row per key: the last by ``order``, on ties and without an order the greatest row."""
    others = [c for c in rows.columns if c != key]
    ranked = F.struct(*([F.col(order).alias("_order")] if order else []), *others)
    return rows.groupBy(key).agg(F.max(ranked).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in others))


def create(rows: DataFrame, path: str, key: str, buckets: int, order: str | None = None) -> None:
    """A new table at ``path`` in ``buckets`` folders: enough that one holds what a task rewrites with ease."""
    one = _latest(rows.where(F.col(key).isNotNull()), key, order).withColumn(BUCKET, _bucket(key, buckets))
    one.repartition(BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def upsert(changes: DataFrame, path: str, key: str, buckets: int, order: str | None = None, replace: bool = True) -> DataFrame:
    """Changes merged into the table at ``path``; returns those that took effect.

    A change whose key is stored replaces its row (``replace``), else it is left out; others are added. Of several changes
    of a key the last by ``order`` counts. Changes without a key are left out. Buckets without changes are neither read nor
    written; those with some are written whole under dynamic partition overwrite, so a retry gives the same table.
    """
    spark = changes.sparkSession
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c != BUCKET]
    new = settled(_latest(changes.where(F.col(key).isNotNull()).select(*columns), key, order).withColumn(BUCKET, _bucket(key, buckets)))
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return new.drop(BUCKET)
    old = stored.where(F.col(BUCKET).isin(touched))
    if replace:
        kept, taken = old.join(new.select(key), key, "left_anti"), new
    else:
        kept, taken = old, settled(new.join(old.select(key), key, "left_anti"))
    merged = settled(kept.select(*columns, BUCKET).unionByName(taken.select(*columns, BUCKET)))
    merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return taken.drop(BUCKET)
