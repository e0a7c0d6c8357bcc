"""Appends that take effect once: data by batch, and a manifest of the batches that are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MANIFEST = "job string, batch string, rows bigint, at timestamp"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:  # nothing was committed yet
        return spark.createDataFrame([], MANIFEST)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(job, batch) that are complete, each once."""
    return _manifest(spark, path).select("job", "batch").distinct()


def append_once(rows: DataFrame, path: str, job: str, batch: str, *partition: str) -> bool:
    """``rows`` appended as one batch of a job; False, and no change, where that batch is already there.

    Data goes to a folder of the batch, which a retry overwrites, and counts only from the moment the manifest names it.
    """
    spark = rows.sparkSession
    if committed(spark, path).where((F.col("job") == job) & (F.col("batch") == batch)).limit(1).count():
        return False
    place = f"{path}/data/job={job}/batch={batch}"
    rows.write.mode("overwrite").partitionBy(*partition).parquet(place)
    count = spark.read.schema(rows.schema).parquet(place).count()
    line = spark.createDataFrame([(job, batch, count)], "job string, batch string, rows bigint").withColumn("at", F.current_timestamp())
    line.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return True


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of complete batches, with their job and batch."""
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    rows = rows.withColumns({"job": F.col("job").cast("string"), "batch": F.col("batch").cast("string")})
    return rows.join(F.broadcast(committed(spark, path)) if few(spark, path) else committed(spark, path), ["job", "batch"], "left_semi")


def few(spark: SparkSession, path: str, most: int = 100_000) -> bool:
    """Whether the manifest may travel to every task."""
    return committed(spark, path).limit(most + 1).count() <= most
