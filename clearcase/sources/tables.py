"""Tables written by jobs: settled stages, appends, resumable run records."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearcase.session import checkpoint_dir
from clearcase.sources import ledger

_OWNERS: list[list[str]] = []


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    Cuts lineage between heavy stages: a lost executor re-reads files instead of
    redoing the stage, readers prune columns, and the optimizer does not have to
    plan both stages as one.  Inside ``owned`` the folder goes with its owner; a
    query that returns before it is read leaves it to the cluster's clean-up of
    that folder.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


def keyed(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by key that grows with the other side: sorted and merged, never broadcast.

    Spark estimates a row of texts made by expressions at 20 bytes a text and from the few columns read for it, so it
    would send whole tables of letters, charts or records through the driver.
    """
    return df.hint("merge")


@contextlib.contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are deleted on leaving, whether the work succeeded or not."""
    _OWNERS.append([])
    try:
        yield
    finally:
        for path in _OWNERS.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def append_usage(rows: DataFrame, path: str, at: str = "created_at", batch: str | None = None) -> None:
    """Usage rows appended by month, so a bill reads its own partition only; a ``batch`` is appended once (``ledger.read``)."""
    rows = rows.withColumn("period", F.date_format(at, "yyyy-MM"))
    if batch is not None:
        ledger.append_once(rows, path, "usage", batch, "period")
    else:
        rows.write.mode("append").partitionBy("period").parquet(path)


def missing_runs(planned: DataFrame, recorded: DataFrame, *keys: str) -> DataFrame:
    """Planned runs that have no record yet; rerunning a broken evaluation resumes."""
    return planned.join(recorded.select(*keys), list(keys), "left_anti")


def append_runs(runs: DataFrame, path: str, batch: str | None = None) -> None:
    """Run records appended by fixture; a ``batch`` is appended once (``ledger.read``)."""
    if batch is not None:
        ledger.append_once(runs, path, "runs", batch, "fixture")
    else:
        runs.write.mode("append").partitionBy("fixture").parquet(path)
