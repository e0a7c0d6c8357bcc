"""Small helpers that several of these operators share."""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_SLICE = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set (tests), one beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: a lost executor re-reads files instead of redoing the work."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, an execution's shuffle files are removed when it ends: steps whose results are written do not add up on disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_fold(doc_id: Column, parts: int, chosen: int) -> Column:
    """Whether crc32 of the id as text leaves ``chosen`` modulo ``parts``; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == chosen


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``TARGET_SLICE`` text bytes, so that working memory does not follow row width."""
    for batch in batches:
        size = batch.column(column).nbytes
        step = max(1, math.ceil(batch.num_rows / max(1, math.ceil(size / TARGET_SLICE))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def ascii_words(text: Column) -> Column:
    """Lower-cased (A-Z only) words between space, tab, line feed, vertical tab, form feed and carriage return."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, lower), r"[\x20\x09-\x0D]+"), lambda w: w != "")
