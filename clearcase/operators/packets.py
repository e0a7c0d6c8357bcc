"""Submission packets: cover, letter body, checklist and file name as one row, ready to be rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearcase import fixed_values as fv
from clearcase.functions import text as tx

ITEM = "struct<label:string,missing:boolean>"


def letter_body(letter: Column | str) -> Column:
    """The letter without its heading, wherever that stands, and without runs of empty lines."""
    heading = rf"(?i)^[#*\s]*{fv.LETTER_HEADING}[#*\s]*$"
    lines = F.filter(F.split(tx.col(letter), r"\r?\n"), lambda line: ~tx.strip(line).rlike(heading))
    return tx.strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def paragraphs(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, r"\n{2,}"), tx.strip), lambda p: p != "")


def checklist() -> Column:
    """The submission checklist; an item that hangs on a field is open while that is null or empty."""
    def missing(field: str | None) -> Column:
        if field is None:
            return F.lit(True)
        return F.size(field) <= 0 if field == "treatments" else F.col(field).isNull()

    return F.array(*[F.struct(F.lit(label).alias("label"), missing(field).alias("missing")) for label, field in fv.PACKET_CHECKLIST]).cast(f"array<{ITEM}>")


def packets(cases: DataFrame, letter: str = "letter", made_on: str = "made_on") -> DataFrame:
    """(case_id, cover, paragraphs, checklist, file_name) of cases that have a letter and the day of its packet.

    A missing patient, provider or payer is said so on the cover; a missing practice is left out.
    """
    given = lambda c: F.coalesce(tx.nonblank(c), F.lit(fv.PACKET_DEFAULTS[c]))
    cover = F.struct(
        given("practice_name").alias("practice_name"), F.coalesce("patient_name", F.lit(fv.PACKET_DEFAULTS["patient_name"])).alias("patient_name"), tx.long_date(F.col(made_on)).alias("date"),
        F.col("cpt_code").alias("cpt_code"), given("provider_name").alias("provider_name"), given("payer_name").alias("payer_name"))
    rows = cases.select("case_id", cover.alias("cover"), letter_body(letter).alias("_body"), checklist().alias("checklist"))
    return rows.select("case_id", "cover", paragraphs(F.col("_body")).alias("paragraphs"), "checklist", tx.packet_file_name("cover.patient_name", "cover.cpt_code").alias("file_name"))
