"""Payer rules: registry with quality gates, matching, checklists, penalties, flags.

The registry is a small table and a parameter of every function here.  The
default one states the fields that decide verdicts (treatment minimums, imaging,
validation status); a site's own policy prose goes into the criteria columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearcase import fixed_values as fv
from clearcase.functions import text as tx
from clearcase.operators.normalize import FLAG

RULE = """payer_id STRING, payer_name STRING, rule_cpt STRING, procedure_name STRING, validation_status STRING,
verification_method STRING, last_verified_date STRING,
requirements ARRAY<STRUCT<treatment:STRING,minimum_duration:STRING,notes:STRING>>,
imaging_requirements ARRAY<STRUCT<modality:STRING,required:BOOLEAN,notes:STRING>>,
functional_criteria ARRAY<STRING>, radiographic_criteria ARRAY<STRING>, additional_documentation ARRAY<STRING>,
denial_risks ARRAY<STRING>, exceptions ARRAY<STRING>, guideline_source STRING"""

KNEE, HIP, CUFF = ("27447", "Total Knee Arthroplasty"), ("27130", "Total Hip Arthroplasty"), ("29827", "Arthroscopic Rotator Cuff Repair")

# Per rule the payer, procedure, validation state, treatment
# minimums (up to the part that is parsed) and imaging with its required mark.
DECISIONS = [
    ("aetna", "Aetna", KNEE, True,
     [("Physical therapy or supervised exercise", "12 or 24 weeks depending on age/BMI"), ("NSAIDs or acetaminophen", "Documented trial"),
      ("Weight management (if BMI ≥30)", "Documented attempt")],
     [("X-ray (weight-bearing bilateral)", True), ("MRI", False)]),
    ("aetna", "Aetna", HIP, True,
     [("Physical therapy or supervised exercise", "12 or 24 weeks depending on age/BMI"), ("NSAIDs or acetaminophen", "Documented trial"),
      ("Assistive devices (cane/walker)", "Documented use"), ("Intra-articular corticosteroid injection", "Trialed")],
     [("X-ray (AP pelvis + lateral hip)", True), ("MRI", False)]),
    ("aetna", "Aetna", CUFF, False,
     [("Physical therapy", "≥6 weeks"), ("NSAIDs or analgesics", "Documented trial"), ("Subacromial corticosteroid injection", "Trialed")],
     [("MRI shoulder (without contrast)", True), ("X-ray shoulder", False)]),
    ("uhc", "UnitedHealthcare", KNEE, False,
     [("NSAIDs or acetaminophen", "≥3 weeks"), ("Physical therapy or home exercise program", "≥12 weeks"), ("Activity modification", "≥12 weeks")],
     [("X-ray (weight-bearing)", True)]),
    ("uhc", "UnitedHealthcare", HIP, False,
     [("NSAIDs or acetaminophen", "≥3 weeks"), ("Physical therapy or home exercise", "≥12 weeks"), ("Activity modification", "≥12 weeks")],
     [("X-ray (AP pelvis + lateral hip)", True)]),
    ("uhc", "UnitedHealthcare", CUFF, False,
     [("Physical therapy", "≥6 weeks"), ("NSAIDs or analgesics", "Documented trial"), ("Activity modification", "Documented")],
     [("MRI shoulder", True)]),
    ("cigna", "Cigna (EviCore managed)", KNEE, True, [("Provider-directed non-surgical management", "3 months")],
     [("X-ray (weight-bearing) or MRI/arthroscopy", True)]),
    ("cigna", "Cigna (EviCore managed)", HIP, True, [("Provider-directed non-surgical management", "3 months")],
     [("X-ray (AP pelvis + lateral hip)", True)]),
    ("cigna", "Cigna (EviCore managed)", CUFF, True, [("Provider-directed non-surgical management", "3 months")],
     [("MRI or CT shoulder", True)]),
    ("anthem_empire", "Anthem / Empire BCBS (Carelon managed)", KNEE, True,
     [("NSAIDs or analgesics", "Documented trial"), ("Physical therapy", "12 weeks"), ("Activity modification", "Documented"),
      ("Intra-articular corticosteroid injection", "Documented attempt")],
     [("X-ray (weight-bearing)", True)]),
    ("anthem_empire", "Anthem / Empire BCBS (Carelon managed)", HIP, True,
     [("Conservative management", "12 weeks"), ("Physical therapy or analgesics", "Documented")],
     [("X-ray (AP pelvis + lateral hip)", True)]),
    ("anthem_empire", "Anthem / Empire BCBS (Carelon managed)", CUFF, True,
     [("Physical therapy or supervised conservative management", "≥6 weeks"), ("NSAIDs or analgesics", "Documented trial"),
      ("Subacromial injection", "Considered")],
     [("MRI shoulder", True)]),
]
VERIFIED_ON = "2026-06-30"

# Short default criteria per procedure; a site replaces them with its policy text.
CRITERIA = {
    "27447": (["Pain limits walking or stairs"], ["Graded knee film with formal report"], ["Dated treatment notes"]),
    "27130": (["Pain limits daily activity", "Gait or motion restricted on exam"], ["Graded hip film with formal report"], ["Dated treatment notes"]),
    "29827": (["Overhead function is lost"], ["Tear confirmed by a radiologist"], ["Exam with strength tests", "Dated treatment notes"]),
}


def default_rules() -> list[tuple]:
    rows = []
    for payer_id, payer, (cpt, procedure), valid, needs, studies in DECISIONS:
        functional, radiographic, documents = CRITERIA[cpt]
        rows.append((
            payer_id, payer, cpt, procedure, "validated" if valid else "unvalidated",
            "direct_fetch_quoted" if valid else "unverified", VERIFIED_ON if valid else None,
            [(t, d, None) for t, d in needs], [(m, r, None) for m, r in studies],
            functional, radiographic, documents, ["Course shorter than the minimum"], ["Acute fracture"], f"{payer} policy",
        ))
    return rows


def violations(rules: DataFrame) -> DataFrame:
    """Rules that break the validation gate, with the reason."""
    valid = F.col("validation_status") == "validated"
    reason = (
        F.when(valid & ~F.col("verification_method").eqNullSafe("direct_fetch_quoted"), "validated without a quoted source")
        .when(valid & F.col("last_verified_date").isNull(), "validated without a date")
        .when((F.col("validation_status") == "unvalidated") & F.col("last_verified_date").isNotNull(), "unvalidated with a date")
    )
    return rules.withColumn("violation", reason).where("violation IS NOT NULL")


def load_rules(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The registry as a table in its order (``ordinal``); refuses to load when a rule breaks the gate."""
    rows = rows if rows is not None else default_rules()
    rules = spark.createDataFrame([(*row, k) for k, row in enumerate(rows)], f"{RULE}, ordinal INT")
    bad = violations(rules).select("payer_id", "rule_cpt", "violation").take(1)
    if bad:
        raise ValueError(f"rule {bad[0].payer_id} {bad[0].rule_cpt} is {bad[0].violation}")
    return rules


# ---- matching -----------------------------------------------------------------

def payer_id_of(payer: Column | str, aliases: list[tuple[str, str]] = fv.PAYER_ALIASES) -> Column:
    """Exact spelling first, then the longest alias contained (declaration order on ties).

    A fold over a short list inside the row: no join, no shuffle, no distinct pass.
    """
    name = F.lower(tx.strip(payer))
    exact = F.create_map(*[F.lit(x) for pair in dict(aliases).items() for x in pair])[name]
    longest_first = sorted(dict(aliases).items(), key=lambda a: -len(a[0]))
    return F.coalesce(exact, *[F.when(tx.contains(name, F.lit(a)), F.lit(i)) for a, i in longest_first])


def with_rule(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Each case once, with the columns of the first rule (by ``ordinal``) for its payer and CPT, null where none is.

    A payer name that is a registered payer id stands for itself.  The optimizer broadcasts the registry by its size in
    bytes; where it is too large, adaptive execution splits the few payers that hold most cases.
    """
    others = [c for c in rules.columns if c not in ("payer_id", "rule_cpt", "ordinal")]
    first = rules.groupBy("payer_id", "rule_cpt").agg(F.min_by(F.struct(*others), "ordinal").alias("r")).select("payer_id", "rule_cpt", "r.*")
    known = rules.select(F.col("payer_id").alias("known_id")).distinct()
    named = cases.join(known, F.col("payer_name") == F.col("known_id"), "left")
    matched = named.withColumn("case_payer_id", F.coalesce("known_id", payer_id_of("payer_name"))).drop("known_id")
    on = (matched.case_payer_id == first.payer_id) & (matched.cpt_code == first.rule_cpt)
    return matched.join(first.withColumnRenamed("payer_name", "rule_payer_name"), on, "left").drop(first.payer_id)


def is_validated() -> Column:
    return F.coalesce(F.col("validation_status") == "validated", F.lit(False))


def criteria_text() -> Column:
    """The rule rendered for a letter writer; null unless the rule is validated."""
    bullets = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    care = F.array_join(F.transform("requirements", lambda r: F.concat(
        F.lit("- "), r["treatment"], F.lit(": "), r["minimum_duration"],
        F.coalesce(F.concat(F.lit(" ["), r["notes"], F.lit("]")), F.lit("")))), "\n")
    studies = F.array_join(F.transform("imaging_requirements", lambda i: F.concat(
        F.lit("- "), i["modality"], F.when(i["required"], " [REQUIRED]: ").otherwise(" [OPTIONAL]: "), F.coalesce(i["notes"], F.lit("")))), "\n")
    block = F.concat_ws("\n\n",
        F.concat(F.lit("PAYER-SPECIFIC REQUIREMENTS — "), F.col("rule_payer_name"), F.lit(" | CPT "), F.col("rule_cpt"), F.lit(":")),
        F.concat(F.lit("CONSERVATIVE CARE MINIMUMS:\n"), care), F.concat(F.lit("IMAGING REQUIREMENTS:\n"), studies),
        F.concat(F.lit("FUNCTIONAL CRITERIA:\n"), bullets("functional_criteria")),
        F.concat(F.lit("DENIAL RISK FLAGS:\n"), bullets("denial_risks")),
        F.concat(F.lit("AUTO-APPROVAL EXCEPTIONS:\n"), bullets("exceptions")))
    return F.when(is_validated(), block)


# ---- verdicts -------------------------------------------------------------------

def candidate_phrases(requirement: Column) -> Column:
    bare = tx.strip(F.regexp_replace(requirement, r"\([^)]*\)", ""))
    parts = F.transform(F.split(bare, r"(?i)\s+or\s+|/"), lambda p: F.lower(tx.strip(p)))
    return F.filter(parts, lambda p: F.length(p) >= 3)


def negated_before(prefix: Column) -> Column:
    """A negation word among the last four words of ``prefix``."""
    words = F.split(tx.strip(prefix), r"\s+")
    last = F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), 4)
    return F.exists(last, lambda w: F.regexp_replace(w, "[^a-z]", "").isin(*fv.NEGATION_WORDS))


def matching_treatments(requirement: Column, treatments: Column) -> Column:
    """Treatments whose name holds one of the requirement's phrases outside a negation."""
    def hit(t: Column) -> Column:
        name = F.lower(t["treatment"])
        at = lambda p: F.instr(name, p)
        return F.exists(candidate_phrases(requirement), lambda p: (at(p) > 0) & ~negated_before(F.substring(name, F.lit(1), at(p) - 1)))

    return F.filter(treatments, hit)


def longest_weeks(treatments: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(treatments, lambda t: tx.payer_weeks(t["duration"]))), F.lit(0))


def therapy_weeks(treatments: Column) -> Column:
    name = lambda t: F.lower(t["treatment"])
    return longest_weeks(F.filter(treatments, lambda t: tx.contains(name(t), F.lit("physical therapy")) | name(t).rlike(tx.BEGIN + "pt" + tx.END)))


def treatment_verdict(requirement: Column, treatments: Column) -> Column:
    need = tx.payer_weeks(requirement["minimum_duration"])
    found = longest_weeks(matching_treatments(requirement["treatment"], treatments))
    return F.when(~is_validated() | (need == 0) | (found == 0), "unverifiable").when(found >= need, "met").otherwise("not_met")


def core_modality(label: Column) -> Column:
    return F.lower(tx.strip(F.split_part(label, F.lit("("), F.lit(1))))


def imaging_verdict(requirement: Column) -> Column:
    label = core_modality(requirement["modality"])
    seen = tx.contains(F.lower(F.coalesce(F.col("imaging.modality"), F.lit(""))), label)
    return F.when(~is_validated() | (label == ""), "unverifiable").when(seen & (F.col("imaging_status") == "completed"), "met").otherwise("not_met")


ITEM = "struct<label:string,requirement:string,hard:boolean,verdict:string>"


def checklist() -> Column:
    """The rule's items in order: treatments, imaging, functional, radiographic, documents."""
    def soft(column: str, requirement: str) -> Column:
        return F.transform(column, lambda x: F.struct(
            x.alias("label"), F.lit(requirement).alias("requirement"), F.lit(False).alias("hard"), F.lit("unverifiable").alias("verdict")).cast(ITEM))

    care = F.transform("requirements", lambda r: F.struct(
        r["treatment"].alias("label"), F.concat_ws(" — ", r["minimum_duration"], r["notes"]).alias("requirement"),
        F.lit(True).alias("hard"), treatment_verdict(r, F.col("treatments")).alias("verdict")).cast(ITEM))
    studies = F.transform("imaging_requirements", lambda i: F.struct(
        i["modality"].alias("label"), F.coalesce(i["notes"], F.when(i["required"], "Required").otherwise("Optional")).alias("requirement"),
        i["required"].alias("hard"), imaging_verdict(i).alias("verdict")).cast(ITEM))
    every = F.concat(care, studies, soft("functional_criteria", "Functional criterion — address in letter"),
                     soft("radiographic_criteria", "Radiographic criterion"), soft("additional_documentation", "Supporting documentation"))
    return F.coalesce(every, F.array().cast(f"array<{ITEM}>"))


def hard_requirement_flags() -> Column:
    """Flags for failed hard items of a validated rule whose label the record does not carry yet."""
    labels = F.transform("risk_flags", lambda f: f["label"])
    indexed = F.transform("checklist", lambda item, i: F.struct(i.alias("i"), item.alias("item")))

    def flag(x: Column) -> Column:
        item = x["item"]
        return F.struct(
            F.concat(F.lit("payer-hardreq-"), x["i"].cast("string")).alias("id"),
            F.concat(F.lit("Payer requirement not confirmed: "), item["label"]).alias("label"), F.lit("high").alias("severity"),
            F.concat(F.col("rule_payer_name"), F.lit(" requires "), item["label"], F.lit(" ("), item["requirement"], F.lit(").")).alias("explanation"),
            F.concat(F.lit("Confirm "), item["label"], F.lit(" in the chart.")).alias("recommendation"), F.lit("").alias("anchor")).cast(FLAG)

    failed = F.filter(indexed, lambda x: x["item"]["hard"] & (x["item"]["verdict"] == "not_met")
                      & ~F.array_contains(labels, F.concat(F.lit("Payer requirement not confirmed: "), x["item"]["label"])))
    return F.when(is_validated(), F.transform(failed, flag)).otherwise(F.array().cast(f"array<{FLAG}>"))


def refreshed_flags() -> Column:
    """Flags with the payer's stale ones dropped and recomputed."""
    return F.concat(F.filter("risk_flags", lambda f: ~f["id"].startswith("payer-hardreq-")), F.col("new_flags"))


def with_duration_penalty(df: DataFrame) -> DataFrame:
    """Sets the duration factor to 0 when documented therapy is shorter than a validated minimum; never raises it."""
    therapy = F.filter("requirements", lambda r: tx.contains(F.lower(r["treatment"]), F.lit("physical therapy")))
    need = F.coalesce(tx.payer_weeks(F.get(therapy, F.lit(0))["minimum_duration"]), F.lit(0))
    have = therapy_weeks(F.col("treatments"))
    short = is_validated() & (need > 0) & (have > 0) & (have < need)
    note = F.concat(F.col("rule_payer_name"), F.format_string(" requires ≥%d weeks PT. Chart shows %d week", need, have),
                    F.when(have == 1, "").otherwise("s"), F.lit("."))
    demoted = F.struct(F.lit(0).alias("score"), note.alias("note"), F.lit(None).cast("string").alias("anchor"))
    return df.withColumn("strength", F.when(short, F.col("strength").withField("conservative_treatment_duration", demoted)).otherwise(F.col("strength")))


def with_payer_results(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Scored cases with rule, penalty, checklist and refreshed flags; one broadcast join, no shuffle."""
    ruled = with_duration_penalty(with_rule(cases, rules))
    stale_free = ruled.withColumn("risk_flags", F.filter("risk_flags", lambda f: ~f["id"].startswith("payer-hardreq-")))
    listed = stale_free.withColumn("checklist", checklist())
    return listed.withColumn("new_flags", hard_requirement_flags()).withColumn("risk_flags", refreshed_flags())


def status_rollup(cases: DataFrame) -> DataFrame:
    """Cases by rule state: validated, no source, licensed source, or no rule."""
    key = F.concat_ws(":", "case_payer_id", "rule_cpt")
    state = (F.when(F.col("rule_cpt").isNull(), "no rule").when(is_validated(), "validated")
             .when(key == "aetna:29827", "no primary source").when(key.startswith("uhc:"), "licensed source").otherwise("unaccounted"))
    return cases.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.count_distinct("case_payer_id", "rule_cpt").alias("rules"))


def corrected_cpt(supplement: Column, cpt: Column) -> Column:
    """A known, different five-digit code from the supplement, else the case's own."""
    from clearcase.operators.scoring import known_cpt

    code = tx.extract(supplement, r"\d{5}")
    return F.when(known_cpt(code) & (code != cpt), code).otherwise(cpt)


def letter_with_cpt(letter: Column, old: Column, new: Column) -> Column:
    pattern = F.concat(F.lit(tx.BEGIN), tx.literal(old), F.lit(tx.END))
    return F.when(old != new, F.regexp_replace(letter, pattern, new)).otherwise(letter)


def allowed_citations(citations: Column) -> Column:
    """Citations survive only under a validated rule."""
    return F.when(is_validated(), citations).otherwise(F.array().cast("array<string>"))
