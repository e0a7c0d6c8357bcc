"""Evaluation: expectation checks, repeated-run pass rates, baselines, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcase.functions import text as tx
from clearcase.sources.tables import keyed

BASE_RUNS, ESCALATED_RUNS = 5, 10
CHARS_PER_TOKEN, INPUT_USD_PER_MILLION, OUTPUT_USD_PER_MILLION = 4, 3, 15


def compared(records: DataFrame, expectations: DataFrame) -> DataFrame:
    """One row per expectation with ``passed``.

    ``expectations``: case_id, field, kind (exact, must_include, contains_ci,
    min_count, present, score), expected_text, expected_codes, expected_num.
    """
    e = expectations.join(keyed(records), "case_id")
    text_of = F.coalesce(F.when(F.col("field") == "patient_name", F.col("patient_name")).when(F.col("field") == "date_of_birth", F.col("date_of_birth"))
                         .when(F.col("field") == "requested_procedure", F.col("requested_procedure")), F.lit("(null)"))
    count_of = F.when(F.col("field") == "treatments", F.size("treatments")).when(F.col("field") == "functional_limitations", F.size("functional_limitations"))
    factors = F.create_map(*[x for k in ("diagnosis_codes", "conservative_treatments_named", "imaging_findings", "functional_limitations", "symptom_duration")
                             for x in (F.lit(f"strength.{k}"), F.col(f"strength.{k}.score"))])
    missing = F.array_except("expected_codes", "diagnosis_codes")
    modality = F.lower("imaging.modality")
    present = F.when(F.col("expected_num") == 1, F.col("imaging").isNotNull() & F.coalesce(tx.contains(modality, F.lower("expected_text")), F.lit(True))).otherwise(F.col("imaging").isNull())
    passed = (F.when(F.col("kind") == "exact", text_of == F.col("expected_text")).when(F.col("kind") == "contains_ci", tx.contains(F.lower(text_of), F.lower("expected_text")))
              .when(F.col("kind") == "must_include", F.size(missing) == 0).when(F.col("kind") == "min_count", count_of >= F.col("expected_num"))
              .when(F.col("kind") == "present", present).when(F.col("kind") == "score", F.coalesce(factors[F.col("field")] == F.col("expected_num"), F.lit(False))))
    return e.select("case_id", "field", "kind", passed.alias("passed"), F.when(F.col("kind") == "must_include", missing).alias("missing"))


def summarized(checks: DataFrame) -> DataFrame:
    """Passed and failed per case, failed fields listed (a case has a handful of checks)."""
    return checks.groupBy("case_id").agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("field")))), ",").alias("failures"))


def counted_runs(runs: DataFrame) -> DataFrame:
    """Runs that count: the first five per fixture and route, ten if one of those fails.

    The rank filter lets every task keep at most ten runs per group before the
    shuffle, so a fixture with a third of all runs is no hot spot.
    """
    per = Window.partitionBy("fixture", "route").orderBy("run", "failed")
    first = runs.withColumn("pos", F.row_number().over(per)).where(F.col("pos") <= ESCALATED_RUNS)
    early_fail = F.max(F.when(F.col("pos") <= BASE_RUNS, F.col("failed"))).over(Window.partitionBy("fixture", "route"))
    return first.withColumn("escalated", early_fail == 1).where((F.col("pos") <= BASE_RUNS) | F.col("escalated"))


def pass_rates(runs: DataFrame) -> DataFrame:
    """Pass rate per fixture and route, per fixture, and over all."""
    return runs.rollup("fixture", "route").agg(
        F.count("*").alias("runs"), F.count_if(F.col("failed") == 0).alias("passes"), F.grouping_id().cast("bigint").alias("level")
    ).withColumn("pass_pct", F.floor(F.col("passes") / F.col("runs") * 100 + 0.5))


def baselines(runs: DataFrame) -> DataFrame:
    """First passing run per fixture."""
    return runs.where("failed = 0").groupBy("fixture").agg(F.min_by("case_id", "run").alias("case_id"), F.min("run").alias("run"))


def cost_usd(input_chars: Column, output_chars: Column) -> Column:
    return (input_chars / CHARS_PER_TOKEN * INPUT_USD_PER_MILLION + output_chars / CHARS_PER_TOKEN * OUTPUT_USD_PER_MILLION) / 1_000_000
