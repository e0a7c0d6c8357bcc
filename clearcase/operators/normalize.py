"""Extraction records: JSON of any shape to one typed row, with blocks and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearcase import fixed_values as fv
from clearcase.functions import text as tx
from clearcase.sources.extractions import MARK, marked_fields
from clearcase.sources.tables import keyed

TREATMENT = "struct<treatment:string,duration:string,outcome:string,dates:string,relief_duration:string>"
FLAG = "struct<id:string,label:string,severity:string,explanation:string,recommendation:string,anchor:string>"


# ---- JSON typing (on marked text, see sources.extractions) ---------------

def is_object(value: Column) -> Column:
    return F.coalesce(value.startswith("{"), F.lit(False))


def is_string(value: Column) -> Column:
    return value.startswith(MARK)


def raw_string(value: Column) -> Column:
    return F.when(is_string(value), F.substring(value, 2, 1 << 30))


def as_text(value: Column) -> Column:
    return F.when(is_string(value), F.substring(value, 2, 1 << 30)).otherwise(value)


def nullable_string(value: Column) -> Column:
    return tx.nonblank(raw_string(value))


def number(value: Column) -> Column:
    return F.when(value.rlike("^-?[0-9]"), value.cast("double"))


def items(value: Column) -> Column:
    """Elements of an array as marked text; anything else gives none."""
    return F.when(value.startswith("["), F.from_json(value, "array<string>"))


def string_array(value: Column) -> Column:
    kept = F.filter(items(value), lambda v: F.coalesce(nullable_string(v).isNotNull(), F.lit(False)))
    return F.coalesce(F.transform(kept, raw_string), F.array().cast("array<string>"))


def safe_numeric(value: Column) -> Column:
    return F.coalesce(number(value), tx.extract(raw_string(value), r"\d+(?:\.\d+)?").cast("double"))


def imaging_status(value: Column) -> Column:
    status = raw_string(value)
    return F.when(status.isin("pending", "not_ordered", "completed"), status).otherwise("not_ordered")


# ---- nested fields -------------------------------------------------------

def treatments(value: Column) -> Column:
    def one(v: Column, o: Column) -> Column:
        name = F.when(is_object(v), nullable_string(F.coalesce(o["treatment_name"], o["treatment"], o["name"]))).otherwise(nullable_string(v))
        return F.struct(
            F.coalesce(name, F.lit("Unknown Treatment")).alias("treatment"),
            F.coalesce(nullable_string(o["duration"]), F.lit("Unknown")).alias("duration"),
            F.coalesce(nullable_string(o["outcome"]), F.lit("Failed")).alias("outcome"),
            F.coalesce(nullable_string(o["dates"]), F.lit("Not documented")).alias("dates"),
            nullable_string(o["relief_duration"]).alias("relief_duration"),
        ).cast(TREATMENT)

    keys = "treatment_name treatment name duration outcome dates relief_duration".split()
    opened = F.transform(items(value), lambda v: F.struct(v.alias("v"), F.when(is_object(v), marked_fields(v, *keys)).alias("o")))
    return F.coalesce(F.transform(opened, lambda x: one(x["v"], x["o"])), F.array().cast(f"array<{TREATMENT}>"))


IMAGING = "struct<modality:string,key_findings:string>"


def opened_imaging(value: Column) -> Column:
    """The imaging object with its X-ray and MRI parts opened."""
    whole = F.when(is_object(value), marked_fields(value, "modality", "key_findings", "findings", "xray", "mri"))
    part = lambda v: F.when(is_object(v), marked_fields(v, "completed", "date", "findings"))
    return tx.let(whole, lambda w: F.struct(w.alias("w"), part(w["xray"]).alias("xray"), part(w["mri"]).alias("mri")))


def imaging(opened: Column) -> Column:
    """modality and key_findings, or null when no study is completed or described."""
    w = opened["w"]
    done = lambda key: F.coalesce(opened[key]["completed"] == "true", F.lit(False))

    def finding(key: str, label: str) -> Column:
        said, day = nullable_string(opened[key]["findings"]), nullable_string(opened[key]["date"])
        return F.when(done(key), F.concat(F.lit(label), F.coalesce(F.concat(F.lit(" ("), day, F.lit(")")), F.lit("")), F.lit(": "), said))

    by_study = F.struct(
        F.concat_ws(" and ", F.when(done("xray"), "X-ray"), F.when(done("mri"), "MRI")).alias("modality"),
        F.nullif(F.concat_ws("; ", finding("xray", "X-ray"), finding("mri", "MRI")), F.lit("")).alias("key_findings"),
    )
    modality = nullable_string(w["modality"])
    findings = nullable_string(F.coalesce(w["key_findings"], w["findings"]))
    plain = F.struct(modality.alias("modality"), findings.alias("key_findings"))
    return F.when(
        w.isNotNull(),
        F.when(opened["xray"].isNotNull() | opened["mri"].isNotNull(), F.when(done("xray") | done("mri"), by_study.cast(IMAGING)))
        .when(modality.isNotNull() | findings.isNotNull(), plain.cast(IMAGING)),
    )


def risk_flags(value: Column) -> Column:
    blank = F.lit("")

    def one(v: Column, o: Column, i: Column) -> Column:
        numbered = F.concat(F.lit("flag-"), (i + 1).cast("string"))
        said = as_text(v)
        label = tx.nonblank(F.regexp_replace(F.substring(said, 1, 60), r"[.!?].*", ""))
        get = lambda key: tx.strip(raw_string(o[key]))
        severity = raw_string(o["severity"])
        obj = is_object(v)
        return F.struct(
            F.coalesce(F.nullif(raw_string(o["id"]), blank), numbered).alias("id"),
            F.coalesce(F.when(obj, get("label")).otherwise(label), F.lit("Documentation Gap")).alias("label"),
            F.when(severity.isin("high", "medium", "low"), severity).otherwise("medium").alias("severity"),
            F.when(obj, F.coalesce(get("explanation"), blank)).otherwise(said).alias("explanation"),
            F.coalesce(get("recommendation"), blank).alias("recommendation"),
            F.coalesce(get("anchorText"), blank).alias("anchor"),
        ).cast(FLAG)

    keys = "id label severity explanation recommendation anchorText".split()
    opened = F.transform(items(value), lambda v: F.struct(v.alias("v"), F.when(is_object(v), marked_fields(v, *keys)).alias("o")))
    return F.coalesce(F.transform(opened, lambda x, i: one(x["v"], x["o"], i)), F.array().cast(f"array<{FLAG}>"))


def judged_factor(source: Column, factor: str) -> Column:
    """A factor the model judged: 1 only for the number 1; null without any judgment object."""
    given = F.when(is_object(source[factor]), marked_fields(source[factor], "score", "note", "anchorText"))
    return F.when(source.isNotNull(), tx.let(given, lambda g: F.struct(
        F.coalesce(number(g["score"]) == 1.0, F.lit(False)).cast("int").alias("score"),
        F.coalesce(tx.strip(raw_string(g["note"])), F.lit("")).alias("note"),
        nullable_string(g["anchorText"]).alias("anchor"))))


def normalized(df: DataFrame) -> DataFrame:
    """From the marked ``record`` to typed columns; the other columns pass through."""
    opened = df.withColumn("_imaging", opened_imaging(F.col("record.imaging_findings"))).withColumn(
        "_judged", F.when(is_object(F.col("record.pa_strength")), marked_fields(F.col("record.pa_strength"), "diagnosis_codes", "surgical_approach")))
    f = lambda key: F.col(f"record.{key}")
    text = lambda key: nullable_string(f(key)).alias(key)
    arrays = lambda key: string_array(f(key)).alias(key)
    return opened.select(
        *[c for c in df.columns if c not in ("record", "raw_json", "parse_failed")],
        text("patient_name"), text("date_of_birth"), arrays("diagnosis_codes"), text("primary_complaint"),
        text("symptom_duration"), arrays("functional_limitations"), arrays("objective_measurements"),
        treatments(f("conservative_treatments_attempted")).alias("treatments"), imaging(F.col("_imaging")).alias("imaging"),
        imaging_status(f("imaging_status")).alias("imaging_status"),
        text("requested_procedure"), nullable_string(f("surgical_approach_if_mentioned")).alias("surgical_approach"),
        text("pain_score"), safe_numeric(f("bmi")).alias("bmi"),
        tx.nonblank(as_text(f("asa_classification"))).alias("asa_classification"),
        risk_flags(f("denial_risk_flags")).alias("risk_flags"),
        judged_factor(F.col("_judged"), "diagnosis_codes").alias("judged_diagnosis"),
        judged_factor(F.col("_judged"), "surgical_approach").alias("judged_approach"),
    )


# ---- blocks and warnings ---------------------------------------------------

def _issue(condition: Column, name: str, label: str, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.struct(F.lit(name).alias("field"), F.lit(label).alias("label"), message.alias("message")))


def hard_blocks() -> Column:
    return F.array_compact(F.array(
        _issue(F.col("patient_name").isNull(), "patient_name", "Patient Name", "The patient must be named."),
        _issue(F.size("diagnosis_codes") == 0, "diagnosis_codes", "Diagnosis Codes", "At least one diagnosis code is needed."),
        _issue(F.col("requested_procedure").isNull(), "requested_procedure", "Requested Procedure", "The procedure must be stated."),
        _issue(F.col("imaging").isNull(), "imaging_findings", "Imaging Findings", "No imaging result is documented."),
        _issue(F.size("treatments") == 0, "conservative_treatments_attempted", "Conservative Treatments", "No conservative care is documented."),
    ))


def chart_surgeon(chart: Column | str) -> Column:
    """The surgeon a chart names: a labelled name first, then a name with MD or DO."""
    name = r"([A-Z][A-Za-z.'\-]+(?:\s+[A-Z][A-Za-z.'\-]+){1,3})"
    labels = "attending surgeon|surgeon|orthopedic surgeon|performed by|scheduled with|requesting surgeon"
    labelled = tx.extract(chart, rf"(?i)(?:{labels})\s*[:\-]?\s*{name}", 1)
    credentialed = tx.extract(chart, rf"(?i)(?:Dr\.?\s+)?{name}\s*,?\s*(?:MD|DO)" + tx.EDGE, 1)
    found = F.coalesce(labelled, credentialed)
    return tx.strip(F.regexp_replace(F.regexp_replace(found, r"\s+", " "), "[;,.]+$", ""))


def names_overlap(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    return tx.contains(x, y) | tx.contains(y, x)


def soft_warnings(chart: Column | str = "chart_text") -> Column:
    text = F.lower(tx.col(chart))
    payer = F.lower(tx.strip("payer_name"))
    surgeon = F.col("chart_surgeon")
    return F.array_compact(F.array(
        _issue(F.col("surgical_approach").isNull(), "surgical_approach_if_mentioned", "Surgical Approach", "The approach strengthens the indication."),
        _issue(F.size("functional_limitations") == 0, "functional_limitations", "Functional Limitations", "Limitations show the impact on daily life."),
        _issue((payer != "") & (text != "") & ~tx.contains(text, F.get(F.split(payer, " "), F.lit(0))), "payer_mismatch", "Payer Name Mismatch",
               F.concat(F.lit("The payer entered ("), F.col("payer_name"), F.lit(") is not in the chart."))),
        _issue((surgeon != "") & ~names_overlap(F.col("provider_name"), surgeon), "provider_mismatch", "Provider Name Mismatch",
               F.concat(F.lit("The provider entered ("), F.col("provider_name"), F.lit(") is not the charted surgeon ("), surgeon, F.lit(")."))),
    ))


def validated(records: DataFrame, charts: DataFrame) -> DataFrame:
    """Records with hard blocks and soft warnings against their chart text."""
    texts = charts.select("chart_id", F.col("text").alias("chart_text"), chart_surgeon("text").alias("chart_surgeon"))
    joined = records.join(keyed(texts), "chart_id", "left")
    return joined.withColumn("hard_blocks", hard_blocks()).withColumn("soft_warnings", soft_warnings())


# ---- projections -------------------------------------------------------------

def without_demo_patients(df: DataFrame) -> DataFrame:
    """Records that do not bear a demonstration patient's name."""
    return df.where(~F.coalesce(tx.strip("patient_name").isin(fv.DEMO_PATIENTS), F.lit(False)))


def letter_safe(df: DataFrame) -> DataFrame:
    """What a letter writer may see: no validation, scores, flags or warnings."""
    hidden = ("hard_blocks", "soft_warnings", "strength", "risk_flags", "extraction_warnings")
    return df.drop(*[c for c in hidden if c in df.columns])


def appeal_safe(df: DataFrame, *keys: str) -> DataFrame:
    """The fields an appeal may use, flags without their anchors."""
    keep = ("diagnosis_codes primary_complaint symptom_duration functional_limitations treatments imaging "
            "requested_procedure surgical_approach bmi asa_classification").split()
    flags = F.transform("risk_flags", lambda f: f.dropFields("anchor")).alias("risk_flags")
    return df.select(*keys, *keep, flags)


def clinical_json() -> Column:
    """The record's clinical facts as JSON text: what a letter's claims must be found in."""
    as_object = lambda t: F.struct(
        t["treatment"].alias("treatment"), t["duration"].alias("duration"), t["outcome"].alias("outcome"),
        t["dates"].alias("dates"), t["relief_duration"].alias("relief_duration"))
    return F.to_json(F.struct(
        "patient_name", "date_of_birth", "diagnosis_codes", "primary_complaint", "symptom_duration",
        "functional_limitations", "objective_measurements",
        F.transform("treatments", as_object).alias("conservative_treatments_attempted"),
        F.col("imaging").alias("imaging_findings"), "imaging_status", "requested_procedure",
        F.col("surgical_approach").alias("surgical_approach_if_mentioned"), "pain_score", number_text("bmi").alias("bmi"), "asa_classification",
    ), {"ignoreNullFields": "false"})


def number_text(c: Column | str) -> Column:
    """A number as written in prose: 31, not 31.0."""
    c = tx.col(c)
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def trailer_lines() -> Column:
    lines = F.concat_ws("\n", F.concat(F.lit("Patient BMI: "), number_text("bmi")),
                        F.concat(F.lit("ASA Classification: "), F.nullif(F.col("asa_classification"), F.lit(""))))
    return F.when(lines == "", "").otherwise(F.concat(F.lit("\n"), lines))


# ---- supplements ---------------------------------------------------------------

CLARIFIED = "; physician-supplied clarification: "


def append_or_set(existing: Column, more: Column) -> Column:
    return F.when(more.isNull(), existing).when(tx.nonblank(existing).isNull(), more).otherwise(
        F.concat(existing, F.lit(CLARIFIED), more))


def push_absent(existing: Column, more: Column) -> Column:
    known = F.exists(existing, lambda e: F.lower(e) == F.lower(more))
    return F.when(more.isNull() | known, existing).otherwise(F.array_append(existing, more))


# The keys that ``merged`` and the CPT correction read.
SUPPLEMENT_KEYS = (
    "symptom_duration", "surgical_approach", "diagnosis_codes", "functional_limitations", "imaging_findings",
    "conservative_treatments_named", "conservative_treatment_duration", "cpt_code_valid",
)


def supplement_map(supplements: DataFrame) -> DataFrame:
    """One map per case: of several values of one key the last by ``seq``; only known keys, which bound its size."""
    known = supplements.where(F.col("key").isin(*SUPPLEMENT_KEYS) & tx.nonblank("value").isNotNull())
    given = known.groupBy("case_id", "key").agg(F.max_by(tx.strip("value"), F.struct("seq", "value")).alias("value"))
    return given.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("supplements"))


def merged(records: DataFrame) -> DataFrame:
    """Records with their ``supplements`` map written back into the fields."""
    given = lambda key: F.col("supplements")[key]
    blank = lambda name, duration: F.struct(
        name.alias("treatment"), duration.alias("duration"), F.lit(None).cast("string").alias("outcome"),
        F.lit(None).cast("string").alias("dates"), F.lit(None).cast("string").alias("relief_duration")).cast(TREATMENT)
    none = F.lit(None).cast("string")
    named, lasting = given("conservative_treatments_named"), given("conservative_treatment_duration")
    with_named = F.when(named.isNull(), F.col("treatments")).otherwise(F.array_append("treatments", blank(named, none)))
    open_ended = lambda ts: F.size(F.filter(ts, lambda t: t["duration"].isNull()))
    filled = lambda ts: F.transform(ts, lambda t: F.when(t["duration"].isNull(), t.withField("duration", lasting)).otherwise(t))
    found = given("imaging_findings")
    imaging_after = F.when(found.isNull(), F.col("imaging")).otherwise(F.struct(
        F.col("imaging.modality").alias("modality"), append_or_set(F.col("imaging.key_findings"), found).alias("key_findings")))
    return (
        records.withColumn("symptom_duration", append_or_set(F.col("symptom_duration"), given("symptom_duration")))
        .withColumn("surgical_approach", append_or_set(F.col("surgical_approach"), given("surgical_approach")))
        .withColumn("diagnosis_codes", push_absent(F.col("diagnosis_codes"), given("diagnosis_codes")))
        .withColumn("functional_limitations", push_absent(F.col("functional_limitations"), given("functional_limitations")))
        .withColumn("imaging", imaging_after)
        .withColumn("treatments", with_named)
        .withColumn("treatments", F.when(lasting.isNull(), F.col("treatments"))
                    .when(open_ended(F.col("treatments")) == 1, filled(F.col("treatments")))
                    .otherwise(F.array_append("treatments", blank(F.lit("Conservative care duration clarification"), lasting))))
    )


SOFT_WARNING_LABELS = {
    "surgical_approach_if_mentioned": "Surgical approach details", "imaging_findings": "Imaging findings",
    "conservative_treatments_attempted": "Conservative treatment history",
    "functional_limitations": "Functional limitations", "payer_mismatch": "Payer name mismatch",
}


def resolution_lines(resolutions: Column) -> Column:
    """Labelled lines for a map of warning field to 'resolved' or 'cant_resolve'."""
    labels = F.create_map(*[F.lit(x) for kv in SOFT_WARNING_LABELS.items() for x in kv])

    def line(e: Column) -> Column:
        label = F.coalesce(labels[e["key"]], e["key"])
        said = F.when(e["value"] == "resolved", ": User has confirmed this is addressed.").when(
            e["value"] == "cant_resolve", ": User has confirmed this cannot be resolved; state it as a known clinical constraint.")
        return F.concat(F.lit("- "), label, said)

    return F.array_join(F.array_compact(F.transform(F.map_entries(resolutions), line)), "\n")


def appeal_response(raw: Column) -> Column:
    """The parts of a drafted appeal, null when the shape is wrong: string points, a string step, string citations."""
    v = marked_fields(raw, "rebuttal_points", "suggested_next_step", "criteria_citations")
    listed = lambda c: F.when(F.forall(items(c), is_string), F.transform(items(c), raw_string))
    parts = tx.let(v, lambda o: F.struct(listed(o["rebuttal_points"]).alias("points"), raw_string(o["suggested_next_step"]).alias("next_step"),
                                         listed(o["criteria_citations"]).alias("citations")))
    return F.when(parts["points"].isNotNull() & parts["next_step"].isNotNull(), parts)
