"""The eight-factor strength score as Column expressions; no shuffle, one row per case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearcase import fixed_values as fv
from clearcase.functions import text as tx

# Letter section a failed factor points to.
SECTION = {
    "history": "CLINICAL HISTORY AND PRESENTING COMPLAINT", "diagnosis": "DIAGNOSIS",
    "limitations": "FUNCTIONAL LIMITATIONS", "treatment": "CONSERVATIVE TREATMENT HISTORY",
    "procedure": "REQUESTED PROCEDURE",
}
FACTOR = "struct<score:int,note:string,anchor:string>"
NO_TREATMENT_NAMES = ("unknown treatment", "conservative treatment history not documented")


def factor(passed: Column, good: Column, bad: Column, section: str) -> Column:
    ok = F.coalesce(passed, F.lit(False))
    return F.struct(ok.cast("int").alias("score"), F.when(ok, good).otherwise(bad).alias("note"),
                    F.when(~ok, F.lit(SECTION[section])).alias("anchor")).cast(FACTOR)


def _n(count: Column, one: str, many: str) -> Column:
    return F.when(count == 1, one).otherwise(many)


def distinct_treatments(treatments: Column) -> Column:
    names = F.transform(treatments, lambda t: F.lower(tx.strip(t["treatment"])))
    return F.size(F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.isin(*NO_TREATMENT_NAMES))))


def treatments_named(treatments: Column) -> Column:
    n = distinct_treatments(treatments)
    return factor(n >= 2, F.format_string("%d distinct conservative treatment modalities documented.", n),
                  F.concat(F.format_string("Only %d distinct conservative treatment modalit", n), _n(n, "y", "ies"), F.lit(" documented (need ≥ 2).")),
                  "treatment")


def duration_share(treatments: Column) -> Column:
    """n course-based treatments and d of them with a stated duration; injections never count."""
    course = F.filter(treatments, lambda t: (t["treatment"] != "") & ~t["treatment"].rlike("(?i)injection"))
    return F.struct(F.size(course).alias("n"), F.size(F.filter(course, lambda t: tx.has_duration(t["duration"]))).alias("d"))


def treatment_duration(treatments: Column) -> Column:
    s = duration_share(treatments)
    n, d = s["n"], s["d"]
    pct = F.when(n > 0, F.floor(d / n * 100 + 0.5)).otherwise(0)
    said = F.format_string("%d of %d duration-eligible treatments have an explicit numeric duration (%d%%). ", d, n, pct)
    few = F.concat(F.format_string("Only %d duration-eligible conservative treatment", n), _n(n, "", "s"),
                   F.lit(" documented (need ≥ 2 course-based treatments; injections are excluded)."))
    return factor((n >= 2) & (pct >= 50), F.concat(said, F.lit("Meets the 50% threshold.")),
                  F.when(n < 2, few).otherwise(F.concat(said, F.lit("Below the 50% threshold."))), "treatment")


def imaging_found(imaging: Column) -> Column:
    return factor(F.coalesce(imaging["key_findings"] != "", F.lit(False)), F.lit("Completed imaging with documented findings."),
                  F.when(imaging.isNotNull(), "Imaging is documented as completed but no specific findings text is present.")
                  .otherwise("No completed imaging with findings is documented."), "diagnosis")


def limitations(listed: Column) -> Column:
    n = F.size(listed)
    return factor(n >= 2, F.format_string("%d specific functional limitations documented.", n),
                  F.concat(F.format_string("Only %d functional limitation", n), _n(n, "", "s"), F.lit(" documented (need ≥ 2).")), "limitations")


def symptom_duration(text: Column) -> Column:
    said = F.concat(F.lit('Symptom duration ("'), text, F.lit('")'))
    return factor(tx.symptom_weeks(text) >= 12, F.concat(said, F.lit(" is ≥ 12 weeks.")),
                  F.coalesce(F.concat(said, F.lit(" does not confirm ≥ 12 weeks.")), F.lit("Symptom duration is not documented.")), "history")


def known_cpt(code: Column) -> Column:
    return F.coalesce(tx.strip(code).isin(fv.KNOWN_CPT_CODES), F.lit(False))


def cpt_valid(code: Column) -> Column:
    shown = F.coalesce(F.nullif(code, F.lit("")), F.lit("(missing)"))
    return factor(known_cpt(code), F.concat(F.lit("CPT "), code, F.lit(" is a recognized orthopedic surgical code.")),
                  F.concat(F.lit("CPT "), shown, F.lit(" is not in the recognized code list — verify against the plan section.")), "procedure")


def diagnosis_present(codes: Column) -> Column:
    n = F.size(codes)
    return factor(n > 0, F.concat(F.format_string("%d diagnosis code", n), _n(n, "", "s"), F.lit(" documented.")),
                  F.lit("No diagnosis codes documented."), "diagnosis")


def approach_present(approach: Column) -> Column:
    return factor(approach != "", F.lit("Surgical approach documented."), F.lit("Surgical approach not documented."), "procedure")


def strength() -> Column:
    """All eight factors over the normalized columns; two prefer the model's judgment where it gave one."""
    c = F.col
    return F.struct(
        F.coalesce(c("judged_diagnosis").cast(FACTOR), diagnosis_present(c("diagnosis_codes"))).alias("diagnosis_codes"),
        treatments_named(c("treatments")).alias("conservative_treatments_named"),
        treatment_duration(c("treatments")).alias("conservative_treatment_duration"),
        imaging_found(c("imaging")).alias("imaging_findings"),
        limitations(c("functional_limitations")).alias("functional_limitations"),
        F.coalesce(c("judged_approach").cast(FACTOR), approach_present(c("surgical_approach"))).alias("surgical_approach"),
        cpt_valid(c("cpt_code")).alias("cpt_code_valid"),
        symptom_duration(c("symptom_duration")).alias("symptom_duration"),
    )


def scored(records: DataFrame) -> DataFrame:
    return records.withColumn("strength", strength())


def earned_weight(strength_col: Column) -> Column:
    """Points of 100."""
    return reduce(Column.__add__, [F.when(strength_col[k]["score"] == 1, w).otherwise(0) for k, w in fv.STRENGTH_WEIGHTS.items()])


def long_factors(df: DataFrame, *keys: str) -> DataFrame:
    """One row per case and factor."""
    s = F.col("strength")
    rows = F.array(*[F.struct(F.lit(k).alias("factor"), F.lit(w).alias("weight"), s[k]["score"].alias("score"),
                              s[k]["note"].alias("note"), s[k]["anchor"].alias("anchor")) for k, w in fv.STRENGTH_WEIGHTS.items()])
    return df.select(*keys, F.inline(rows))


def display_band(earned: Column, open_items: Column) -> Column:
    ready = F.when(open_items > 0, "Strong — clear the open items").otherwise("Ready to submit")
    return F.when(earned >= 80, ready).when(earned >= 50, "Moderate — address gaps before submitting").otherwise("High denial risk — major gaps")


def display_score(earned: Column) -> Column:
    return F.format_number(earned / 10, 1)


# What a reviewer is told to add for a failed factor, and the field's label.
GUIDANCE = {
    "conservative_treatment_duration": ("Add start and end dates of each treatment.", "Treatment timeline details"),
    "imaging_findings": ("Add date, facility, modality and findings; do not submit while imaging is pending.", "Imaging details"),
    "conservative_treatments_named": ("Add every therapy, injection and medication tried.", "Conservative treatments attempted"),
    "functional_limitations": ("Add measurable limits: range, distance, daily tasks.", "Functional limitations"),
    "surgical_approach": ("Add approach, implant type and side.", "Surgical approach details"),
    "symptom_duration": ("Add the onset date or length of symptoms.", "Symptom onset / duration"),
    "diagnosis_codes": ("Add the diagnosis codes of the assessment.", "Diagnosis codes"),
    "cpt_code_valid": ("Check the procedure code against the plan.", "Correct CPT code"),
}


def guidance_for(factors: DataFrame) -> DataFrame:
    """Failing factors with their guidance; an eight-entry lookup, so a map and no join."""
    text = F.create_map(*[F.lit(x) for k, (g, _) in GUIDANCE.items() for x in (k, g)])
    label = F.create_map(*[F.lit(x) for k, (_, i) in GUIDANCE.items() for x in (k, i)])
    failing = factors.where(F.col("score") == 0)
    return failing.withColumn("guidance", F.concat(text[F.col("factor")], F.lit(" "), F.col("note"))).withColumn("input_label", label[F.col("factor")])


def attention_items(cases: DataFrame, acknowledged: Column | None = None) -> DataFrame:
    """Open work per case: failing factors first, then risk flags (done once acknowledged)."""
    done = acknowledged if acknowledged is not None else F.array().cast("array<string>")
    s = F.col("strength")
    fixes = F.filter(F.array(*[
        F.struct(F.lit(k).alias("id"), F.lit("fix").alias("kind"), F.lit(k).alias("label"), s[k]["note"].alias("note"),
                 s[k]["anchor"].alias("anchor"), F.lit(False).alias("done"), s[k]["score"].alias("score"))
        for k in fv.STRENGTH_WEIGHTS]), lambda i: i["score"] < 1)
    shape = "struct<id:string,kind:string,label:string,note:string,anchor:string,done:boolean>"
    fixes = F.transform(fixes, lambda i: i.dropFields("score").cast(shape))
    risks = F.transform("risk_flags", lambda f: F.struct(
        f["id"].alias("id"), F.lit("risk").alias("kind"), f["label"].alias("label"), f["explanation"].alias("note"),
        F.nullif(f["anchor"], F.lit("")).alias("anchor"), F.array_contains(done, f["id"]).alias("done")).cast(shape))
    return cases.withColumn("items", F.concat(fixes, risks)).withColumn(
        "open_count", F.size(F.filter("items", lambda i: ~i["done"])))


def fixes_from_cache(failing: DataFrame, cache: DataFrame, salts: int = 16) -> DataFrame:
    """``failing`` (patient_name, factor, ...) with the ``fix`` that the cache has for its patient and factor, else null.

    Of several cached fixes of a key the greatest counts. A patient with a third of all cases is dealt out over salts, which
    the cache, one row per key, is repeated for. A null patient has no fix.
    """
    one = cache.where(F.col("patient_name").isNotNull()).groupBy("patient_name", "factor").agg(F.max("fix").alias("fix"))
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = failing.withColumn("_salt", F.pmod(F.xxhash64(*failing.columns), F.lit(salts)).cast("int"))
    return dealt.join(spread, ["patient_name", "factor", "_salt"], "left").drop("_salt")
