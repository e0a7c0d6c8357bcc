"""Model extractions: JSON text with fences and chatter to one checked struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearcase.functions.text import strip


def clean_json(raw: Column | str) -> Column:
    """From the first { to the last }, control characters blanked.

    This drops code fences and chatter around the object; text without an
    object stays as it is and then fails to parse.
    """
    text = F.col(raw) if isinstance(raw, str) else raw
    inner = F.regexp_replace(text, r"(?s)^[^{]*(\{.*\})[^}]*$", "$1")
    return F.regexp_replace(inner, r"[\x01-\x1F\x7F-\x9F]", " ")


# Every JSON string, key or value, gets this mark in front.  After parsing all
# fields as text, a marked value was a JSON string, one in braces an object, one
# in brackets an array, and the rest a number or boolean: exact typing with the
# plain text parser, which is far cheaper than inspecting VARIANT values.
MARK = "~"


def marked_json(clean: Column) -> Column:
    # Runs of plain characters between escapes: a loop over single characters takes nearly twice as long.
    return F.regexp_replace(clean, r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"', '"' + MARK + '$1"')


def marked_fields(marked: Column, *keys: str) -> Column:
    """The named members of a marked JSON object as marked text columns of a struct."""
    schema = ", ".join(f"`{MARK}{k}` STRING" for k in keys)
    shape = "struct<" + ",".join(f"{k}:string" for k in keys) + ">"
    return F.from_json(marked, schema).cast(shape)


FIELDS = (
    "patient_name date_of_birth diagnosis_codes primary_complaint symptom_duration functional_limitations "
    "objective_measurements conservative_treatments_attempted imaging_findings imaging_status requested_procedure "
    "surgical_approach_if_mentioned pain_score bmi asa_classification denial_risk_flags pa_strength"
).split()


def _record(clean: Column) -> Column:
    """The marked fields, null unless ``clean`` is one well-formed JSON object."""
    # Parsed as the value of a key, so that text after the object is an error and not ignored.
    wrapped = F.concat(F.lit('{"v":'), clean, F.lit("}"))
    whole = clean.startswith("{") & F.try_parse_json(wrapped).isNotNull()
    return F.when(whole, marked_fields(marked_json(clean), *FIELDS))


def parsed(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Adds ``record`` (a struct of marked text) and ``parse_failed``."""
    with_json = df.withColumn("_json", clean_json(raw)).withColumn("record", _record(F.col("_json"))).drop("_json")
    return with_json.withColumn("parse_failed", F.col("record").isNull())


def records_of(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Rows that parse, with ``record``.

    Rows are dropped by exploding an absent array: a filter would be pushed
    below the projection and parse every text a second time.
    """
    with_json = df.withColumn("_json", clean_json(raw)).withColumn("_record", _record(F.col("_json")))
    kept = F.when(F.col("_record").isNotNull(), F.array("_record"))
    return with_json.select(*df.columns, F.explode(kept).alias("record"))


def rejects_of(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Rows that do not parse, raw text kept for repair; together with the records nothing is lost."""
    return parsed(df, raw).where("parse_failed").drop("record")
