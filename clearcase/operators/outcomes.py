"""Outcome records: validation, the capped newest-first view, denial rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearcase import fixed_values as fv

OUTCOMES = ("approved", "denied", "pending")


def rejection() -> Column:
    """Why a submitted outcome is refused; null when it is accepted."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return (
        F.when(blank("cpt_code"), "cpt_code")
        .when(blank("payer_name"), "payer_name")
        .when(F.col("outcome").isNull() | ~F.col("outcome").isin(*OUTCOMES), "outcome")
        .when(F.col("pa_score").isNull() | F.isnan("pa_score"), "pa_score")
        .when(F.length("denial_reason") > fv.MAX_REASON_CHARS, "denial_reason")
    )


def checked(submissions: DataFrame) -> DataFrame:
    """Trimmed records with a ``rejected`` column; a reason is kept only on denials."""
    return submissions.select(
        "id", "ts", F.trim("cpt_code").alias("cpt_code"), F.trim("payer_name").alias("payer_name"), "outcome",
        F.when(F.col("outcome") == "denied", F.expr("nullif(trim(denial_reason), '')")).alias("denial_reason"),
        "pa_score", rejection().alias("rejected"),
    )


def newest(records: DataFrame, cap: int = fv.OUTCOME_CAP) -> DataFrame:
    """The capped list view: a top-k, so only ``cap`` rows per task reach the merge."""
    return records.orderBy(F.desc("ts"), F.desc("id")).limit(cap)


def score_band(score: Column) -> Column:
    return F.when(score >= 8, "strong").when(score >= 5, "moderate").otherwise("high risk")


def denial_rates(records: DataFrame) -> DataFrame:
    """Outcome counts and denial share by payer x CPT x band with all subtotals."""
    banded = records.withColumn("band", score_band(F.col("pa_score")))
    return (
        banded.cube("payer_name", "cpt_code", "band")
        .agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "denied").alias("denied"),
             F.count_if(F.col("outcome") == "approved").alias("approved"),
             F.grouping_id().cast("bigint").alias("level"))
        .withColumn("denial_rate", F.round(F.col("denied") / F.col("n"), 6))
    )
