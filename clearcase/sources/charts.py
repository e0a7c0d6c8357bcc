"""Chart files: a gate over binary files, and text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearcase import fixed_values as fv


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, length, content); content is pruned where only the gate's other columns are used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file, whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def gated(files: DataFrame) -> DataFrame:
    """Adds ``text`` (for text files) and ``rejected``: type, size, magic bytes or too short; null when accepted."""
    name = F.lower("path")
    pdf, docx, txt = (name.endswith(e) for e in (".pdf", ".docx", ".txt"))
    text = F.when(txt, F.decode("content", "UTF-8"))
    magic = (pdf & (F.substring("content", 1, 5) != F.encode(F.lit("%PDF-"), "UTF-8"))) | (
        docx & (F.substring("content", 1, 4) != F.unhex(F.lit("504B0304"))))
    reason = (
        F.when(~(pdf | docx | txt), "type").when(F.col("length") > fv.MAX_UPLOAD_BYTES, "size")
        .when(magic, "magic").when(txt & (F.length(text) < fv.MIN_CHART_CHARS), "short")
    )
    return files.withColumn("text", text).withColumn("rejected", reason)
