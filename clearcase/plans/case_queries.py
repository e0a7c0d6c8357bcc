"""Queries over extraction records: parsing, normalizing, scoring, payer rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearcase.bindings import bound, cte
from clearcase.functions import text as tx
from clearcase.operators import normalize as nz
from clearcase.operators import rules as rl
from clearcase.operators import scoring as sc
from clearcase.plans import case_oracle as o
from clearcase.plans.registry import query
from clearcase.sources import extractions as ex
from clearcase.sources.tables import keyed, settled

HASH_KEY = "test-key"


def records(spark, sf):
    return nz.normalized(ex.records_of(bound(spark, sf, "raw_extractions")))


def cases(spark, sf):
    return rl.with_payer_results(sc.scored(records(spark, sf)), rl.load_rules(spark))


def joined(column, sep="|"):
    return F.array_join(column, sep)


@query("extraction_parse", f"WITH {o.PARSED} SELECT case_id, r IS NULL AS parse_failed, CASE WHEN r IS NOT NULL THEN len(json_keys(r)) END AS keys FROM c2")
def extraction_parse(spark, sf):
    both = ex.parsed(bound(spark, sf, "raw_extractions"))
    keys = F.size(F.json_object_keys(ex.clean_json("raw_json")))
    return both.select("case_id", "parse_failed", F.when(~F.col("parse_failed"), keys).cast("bigint").alias("keys"))


@query("extraction_rejects", f"WITH {o.PARSED} SELECT case_id, length(raw_json) AS raw_chars FROM c2 WHERE r IS NULL")
def extraction_rejects(spark, sf):
    return ex.rejects_of(bound(spark, sf, "raw_extractions")).select("case_id", F.length("raw_json").cast("bigint").alias("raw_chars"))


@query("record_scalars", f"""WITH {o.NORM}
SELECT case_id, patient_name, date_of_birth, primary_complaint, symptom_duration, imaging_status, requested_procedure,
       surgical_approach, pain_score, bmi, asa_classification FROM norm""")
def record_scalars(spark, sf):
    return records(spark, sf).select("case_id", "patient_name", "date_of_birth", "primary_complaint", "symptom_duration", "imaging_status",
                                     "requested_procedure", "surgical_approach", "pain_score", "bmi", "asa_classification")


@query("record_lists", f"""WITH {o.NORM}
SELECT case_id, array_to_string(diagnosis_codes, '|') AS diagnosis_codes, array_to_string(functional_limitations, '|') AS functional_limitations,
       array_to_string(objective_measurements, '|') AS objective_measurements FROM norm""")
def record_lists(spark, sf):
    return records(spark, sf).select("case_id", *[joined(c).alias(c) for c in ("diagnosis_codes", "functional_limitations", "objective_measurements")])


@query("record_treatments", f"""WITH {o.NORM}
SELECT case_id, k - 1 AS pos, treatments[k].treatment AS treatment, treatments[k].duration AS duration, treatments[k].outcome AS outcome,
       treatments[k].dates AS dates, treatments[k].relief_duration AS relief_duration FROM norm CROSS JOIN range(1, 20) g(k) WHERE k <= len(treatments)""")
def record_treatments(spark, sf):
    return records(spark, sf).select("case_id", F.posexplode("treatments").alias("pos", "t")).select("case_id", F.col("pos").cast("bigint").alias("pos"), "t.*")


@query("record_imaging", f"WITH {o.NORM} SELECT case_id, modality, findings AS key_findings FROM norm")
def record_imaging(spark, sf):
    return records(spark, sf).select("case_id", "imaging.modality", "imaging.key_findings")


@query("record_risk_flags", f"""WITH {o.NORM}
SELECT case_id, k - 1 AS pos, f.* FROM (SELECT case_id, k, risk_flags[k] AS f FROM norm CROSS JOIN range(1, 20) g(k) WHERE k <= len(risk_flags))""")
def record_risk_flags(spark, sf):
    return records(spark, sf).select("case_id", F.posexplode("risk_flags").alias("pos", "f")).select("case_id", F.col("pos").cast("bigint").alias("pos"), "f.*")


_HARD = """list_filter([CASE WHEN patient_name IS NULL THEN 'patient_name' END, CASE WHEN len(diagnosis_codes) = 0 THEN 'diagnosis_codes' END,
  CASE WHEN requested_procedure IS NULL THEN 'requested_procedure' END,
  CASE WHEN modality IS NULL AND findings IS NULL THEN 'imaging_findings' END,
  CASE WHEN len(treatments) = 0 THEN 'conservative_treatments_attempted' END], lambda x: x IS NOT NULL)"""


@query("record_hard_blocks", f"WITH {o.NORM} SELECT case_id, array_to_string({_HARD}, '|') AS fields FROM norm")
def record_hard_blocks(spark, sf):
    return records(spark, sf).select("case_id", joined(F.transform(nz.hard_blocks(), lambda b: b["field"])).alias("fields"))


@query("record_soft_warnings", f"""WITH {o.NORM}, {cte('charts')},
w AS (SELECT case_id, list_filter([CASE WHEN surgical_approach IS NULL THEN 'surgical_approach_if_mentioned' END,
  CASE WHEN len(functional_limitations) = 0 THEN 'functional_limitations' END,
  CASE WHEN NOT contains(lower(c.text), split_part(lower(trim(payer_name)), ' ', 1)) THEN 'payer_mismatch' END], lambda x: x IS NOT NULL) AS fields
  FROM norm JOIN charts c ON c.chart_id = norm.chart_id)
SELECT case_id, array_to_string(fields, '|') AS fields FROM w""")
def record_soft_warnings(spark, sf):
    checked = nz.validated(records(spark, sf), bound(spark, sf, "charts"))
    kinds = F.filter(F.transform("soft_warnings", lambda w: w["field"]), lambda x: x != "provider_mismatch")
    return checked.select("case_id", joined(kinds).alias("fields"))


# A name as RE2 reads it; a quote in SQL is two.
_NAME = r"([A-Z][A-Za-z.''\-]+(?:\s+[A-Z][A-Za-z.''\-]+){1,3})"


@query("chart_surgeon_mismatch", rf"""WITH {o.NORM}, {cte('charts')},
s AS (SELECT chart_id, coalesce(nullif(regexp_extract(text, '(?i)(?:attending surgeon|surgeon|orthopedic surgeon|performed by|scheduled with|requesting surgeon)\s*[:\-]?\s*{_NAME}', 1), ''),
  nullif(regexp_extract(text, '(?i)(?:Dr\.?\s+)?{_NAME}\s*,?\s*(?:MD|DO)\b', 1), '')) AS n FROM charts),
t AS (SELECT chart_id, trim(regexp_replace(regexp_replace(n, '\s+', ' ', 'g'), '[;,.]+$', '')) AS n FROM s)
SELECT case_id, n AS chart_surgeon, coalesce(n <> '' AND NOT contains(lower(provider_name), lower(n)) AND NOT contains(lower(n), lower(provider_name)), false) AS mismatch
FROM norm LEFT JOIN t ON t.chart_id = norm.chart_id""")
def chart_surgeon_mismatch(spark, sf):
    """Surgeon named in the chart and whether the request's provider differs."""
    checked = nz.validated(records(spark, sf), bound(spark, sf, "charts"))
    return checked.select("case_id", "chart_surgeon", F.exists("soft_warnings", lambda w: w["field"] == "provider_mismatch").alias("mismatch"))


@query("letter_safe_record")
def letter_safe_record(spark, sf):
    kept = nz.letter_safe(sc.scored(records(spark, sf)))
    return kept.select("case_id", F.xxhash64(nz.clinical_json()).alias("fingerprint"), F.lit(",".join(sorted(kept.columns))).alias("columns"))


@query("appeal_safe_record", f"""WITH {o.NORM}
SELECT case_id, primary_complaint, symptom_duration, requested_procedure, surgical_approach, bmi, asa_classification,
       len(diagnosis_codes) AS codes, len(treatments) AS treatments, array_to_string(list_transform(risk_flags, lambda f: f.id || '/' || f.severity), '|') AS flags FROM norm""")
def appeal_safe_record(spark, sf):
    kept = nz.appeal_safe(records(spark, sf), "case_id")
    return kept.select("case_id", "primary_complaint", "symptom_duration", "requested_procedure", "surgical_approach", "bmi", "asa_classification",
                       F.size("diagnosis_codes").cast("bigint").alias("codes"), F.size("treatments").cast("bigint").alias("treatments"),
                       joined(F.transform("risk_flags", lambda f: F.concat_ws("/", f["id"], f["severity"]))).alias("flags"))


_BMI = "CASE WHEN bmi = floor(bmi) THEN CAST(CAST(bmi AS BIGINT) AS VARCHAR) ELSE CAST(bmi AS VARCHAR) END"


@query("record_trailer_lines", f"""WITH {o.NORM},
l AS (SELECT case_id, concat_ws(chr(10), 'Patient BMI: ' || {_BMI}, 'ASA Classification: ' || asa_classification) AS t FROM norm)
SELECT case_id, CASE WHEN t = '' THEN '' ELSE chr(10) || t END AS lines FROM l""")
def record_trailer_lines(spark, sf):
    return records(spark, sf).select("case_id", nz.trailer_lines().alias("lines"))


@query("clinical_json_facts", f"""WITH {o.NORM}
SELECT case_id, patient_name, symptom_duration, bmi, len(treatments) AS treatments, treatments[1].dates AS first_dates, findings, 15 AS keys FROM norm""")
def clinical_json_facts(spark, sf):
    """Read back from the JSON text that grounding searches."""
    v = F.parse_json("facts")
    got = lambda path, kind: F.try_variant_get(v, path, kind)
    return records(spark, sf).select("case_id", nz.clinical_json().alias("facts")).select(
        "case_id", got("$.patient_name", "string").alias("patient_name"), got("$.symptom_duration", "string").alias("symptom_duration"),
        got("$.bmi", "double").alias("bmi"),
        F.size(got("$.conservative_treatments_attempted", "array<variant>")).cast("bigint").alias("treatments"),
        got("$.conservative_treatments_attempted[0].dates", "string").alias("first_dates"),
        got("$.imaging_findings.key_findings", "string").alias("findings"),
        F.size(F.map_keys(got("$", "map<string,variant>"))).cast("bigint").alias("keys"))


@query("demo_record_exclusion", f"WITH {o.NORM} SELECT count(*) AS n FROM norm WHERE trim(coalesce(patient_name, '')) NOT IN ('Maria A. Delgado', 'Robert Chen', 'Eleanor Vance')")
def demo_record_exclusion(spark, sf):
    return nz.without_demo_patients(records(spark, sf)).agg(F.count("*").alias("n"))


@query("appeal_request_checks", f"""WITH {cte('outcomes')}
SELECT id, CASE WHEN coalesce(trim(cpt_code), '') = '' OR coalesce(trim(payer_name), '') = '' OR coalesce(trim(denial_reason), '') = '' THEN 'missing'
            WHEN length(denial_reason) > 5000 THEN 'too long' END AS rejected FROM outcomes WHERE outcome = 'denied'""")
def appeal_request_checks(spark, sf):
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    denied = bound(spark, sf, "outcomes").where("outcome = 'denied'")
    return denied.select("id", F.when(blank("cpt_code") | blank("payer_name") | blank("denial_reason"), "missing")
                         .when(F.length("denial_reason") > 5000, "too long").alias("rejected"))


# ---- scoring -----------------------------------------------------------------

@query("strength_factors", f"""WITH {o.SCORED}
SELECT case_id, factor, weight, score FROM (
  SELECT case_id, unnest([{{'factor': 'diagnosis_codes', 'weight': 10, 'score': f_dx}}, {{'factor': 'conservative_treatments_named', 'weight': 20, 'score': f_named}},
    {{'factor': 'conservative_treatment_duration', 'weight': 10, 'score': f_dur0}}, {{'factor': 'imaging_findings', 'weight': 15, 'score': f_img}},
    {{'factor': 'functional_limitations', 'weight': 15, 'score': f_lim}}, {{'factor': 'surgical_approach', 'weight': 10, 'score': f_app}},
    {{'factor': 'cpt_code_valid', 'weight': 10, 'score': f_cpt}}, {{'factor': 'symptom_duration', 'weight': 10, 'score': f_sym}}], recursive := true) FROM scored)""")
def strength_factors(spark, sf):
    return sc.long_factors(sc.scored(records(spark, sf)), "case_id").select("case_id", "factor", "weight", "score")


@query("strength_notes", f"""WITH {o.SCORED}
SELECT case_id,
  CASE WHEN named >= 2 THEN named || ' distinct conservative treatment modalities documented.'
       ELSE 'Only ' || named || ' distinct conservative treatment modalit' || CASE WHEN named = 1 THEN 'y' ELSE 'ies' END || ' documented (need ≥ 2).' END AS named_note,
  CASE WHEN len(functional_limitations) >= 2 THEN len(functional_limitations) || ' specific functional limitations documented.'
       ELSE 'Only ' || len(functional_limitations) || ' functional limitation' || CASE WHEN len(functional_limitations) = 1 THEN '' ELSE 's' END || ' documented (need ≥ 2).' END AS limitation_note,
  CASE WHEN symptom_duration IS NULL THEN 'Symptom duration is not documented.'
       ELSE 'Symptom duration ("' || symptom_duration || '")' || CASE WHEN f_sym = 1 THEN ' is ≥ 12 weeks.' ELSE ' does not confirm ≥ 12 weeks.' END END AS symptom_note,
  CASE WHEN dn >= 2 THEN dd || ' of ' || dn || ' duration-eligible treatments have an explicit numeric duration (' || CAST(floor(dd / dn * 100 + 0.5) AS BIGINT) || '%). '
       || CASE WHEN f_dur0 = 1 THEN 'Meets' ELSE 'Below' END || ' the 50% threshold.'
       ELSE 'Only ' || dn || ' duration-eligible conservative treatment' || CASE WHEN dn = 1 THEN '' ELSE 's' END || ' documented (need ≥ 2 course-based treatments; injections are excluded).' END AS duration_note,
  CASE WHEN f_cpt = 1 THEN 'CPT ' || cpt_code || ' is a recognized orthopedic surgical code.' ELSE 'CPT ' || cpt_code || ' is not in the recognized code list — verify against the plan section.' END AS cpt_note
FROM scored""")
def strength_notes(spark, sf):
    s = lambda k: F.col(f"strength.{k}.note")
    return sc.scored(records(spark, sf)).select(
        "case_id", s("conservative_treatments_named").alias("named_note"), s("functional_limitations").alias("limitation_note"),
        s("symptom_duration").alias("symptom_note"), s("conservative_treatment_duration").alias("duration_note"), s("cpt_code_valid").alias("cpt_note"))


@query("earned_weight", f"""WITH {o.RULED}
SELECT case_id, points, round(points / 10, 1) AS score,
  CASE WHEN points >= 80 THEN 'strong' WHEN points >= 50 THEN 'moderate' ELSE 'high risk' END AS band FROM earned""")
def earned_weight(spark, sf):
    scored = cases(spark, sf).select("case_id", sc.earned_weight(F.col("strength")).alias("points"))
    return scored.select("case_id", "points", F.round(F.col("points") / 10, 1).alias("score"),
                         F.when(F.col("points") >= 80, "strong").when(F.col("points") >= 50, "moderate").otherwise("high risk").alias("band"))


@query("earned_weight_long_form", f"""WITH {o.SCORED}
SELECT case_id, f_dx * 10 + f_named * 20 + f_dur0 * 10 + f_img * 15 + f_lim * 15 + f_app * 10 + f_cpt * 10 + f_sym * 10 AS points FROM scored""")
def earned_weight_long_form(spark, sf):
    """The same sum over the long factor table, one map-side combined aggregate."""
    factors = sc.long_factors(sc.scored(records(spark, sf)), "case_id")
    return factors.groupBy("case_id").agg(F.sum(F.col("score") * F.col("weight")).alias("points"))


_FACTORS = {"conservative_treatments_named": "f_named", "conservative_treatment_duration": "f_dur0", "imaging_findings": "f_img", "symptom_duration": "f_sym",
            "functional_limitations": "f_lim", "diagnosis_codes": "f_dx", "surgical_approach": "f_app", "cpt_code_valid": "f_cpt"}


@query("factor_failure_rates", f"""WITH {o.SCORED}
SELECT cpt_code, count(*) AS n, {', '.join(f'count(*) FILTER ({f} = 0) AS {k}' for k, f in _FACTORS.items())} FROM scored GROUP BY 1""")
def factor_failure_rates(spark, sf):
    failed = [F.count_if(F.col(f"strength.{k}.score") == 0).alias(k) for k in _FACTORS]
    return sc.scored(records(spark, sf)).groupBy("cpt_code").agg(F.count("*").alias("n"), *failed)


@query("duration_parsing", f"""WITH {o.NORM}, t AS (
  SELECT case_id, NULL AS pos, symptom_duration AS d FROM norm
  UNION ALL SELECT case_id, generate_subscripts(treatments, 1) - 1, unnest(treatments).duration FROM norm)
SELECT case_id, pos, CASE WHEN pos IS NULL THEN {o.symptom_weeks('d')} ELSE {o.weeks("d")} END AS weeks, coalesce({o.has_duration("d")}, false) AS has_duration FROM t""")
def duration_parsing(spark, sf):
    """The symptom's and every treatment's duration; one pass over the records, as a union of two would parse them twice."""
    of = lambda pos, d: F.struct(pos.cast("bigint").alias("pos"), d.alias("d"))
    every = F.concat(F.array(of(F.lit(None), F.col("symptom_duration"))), F.transform("treatments", lambda t, i: of(i, t["duration"])))
    stated = records(spark, sf).select("case_id", F.inline(every))
    weeks = F.when(F.col("pos").isNull(), tx.symptom_weeks("d")).otherwise(F.coalesce(tx.payer_weeks(F.col("d")), F.lit(0)))
    return stated.select("case_id", "pos", weeks.alias("weeks"), tx.has_duration(F.col("d")).alias("has_duration"))


@query("factor_guidance", f"""WITH {o.SCORED}
SELECT case_id, 'imaging_findings' AS factor, 'Imaging details' AS input_label FROM scored WHERE f_img = 0
UNION ALL SELECT case_id, 'symptom_duration', 'Symptom onset / duration' FROM scored WHERE f_sym = 0
UNION ALL SELECT case_id, 'cpt_code_valid', 'Correct CPT code' FROM scored WHERE f_cpt = 0
UNION ALL SELECT case_id, 'functional_limitations', 'Functional limitations' FROM scored WHERE f_lim = 0
UNION ALL SELECT case_id, 'surgical_approach', 'Surgical approach details' FROM scored WHERE f_app = 0
UNION ALL SELECT case_id, 'diagnosis_codes', 'Diagnosis codes' FROM scored WHERE f_dx = 0
UNION ALL SELECT case_id, 'conservative_treatments_named', 'Conservative treatments attempted' FROM scored WHERE f_named = 0
UNION ALL SELECT case_id, 'conservative_treatment_duration', 'Treatment timeline details' FROM scored WHERE f_dur0 = 0""")
def factor_guidance(spark, sf):
    return sc.guidance_for(sc.long_factors(sc.scored(records(spark, sf)), "case_id")).select("case_id", "factor", "input_label")


@query("cached_fixes")
def cached_fixes(spark, sf):
    """Fixes already written for a (patient, factor), joined to today's failing factors of the same patient."""
    scored = settled(sc.scored(records(spark, sf)).select("case_id", "patient_name", "strength"))
    factors = sc.long_factors(scored, "case_id", "patient_name")
    cache = factors.where("score = 1 AND patient_name IS NOT NULL").groupBy("patient_name", "factor").agg(F.max_by("note", "case_id").alias("fix"))
    failing = factors.where("score = 0").select("case_id", "patient_name", "factor")
    return sc.fixes_from_cache(failing, cache).select("case_id", "factor", "fix")


@query("attention_items", f"""WITH {o.RULED},
f AS (SELECT case_id, list_filter(risk_flags, lambda f: NOT starts_with(f.id, 'payer-hardreq-')) AS kept FROM earned),
h AS (SELECT c.case_id, count(*) AS n FROM checked c JOIN earned e ON e.case_id = c.case_id JOIN f ON f.case_id = c.case_id
      WHERE c.hard AND c.verdict = 'not_met' AND NOT list_contains(list_transform(f.kept, lambda x: x.label), 'Payer requirement not confirmed: ' || c.label) GROUP BY 1),
a AS (SELECT e.case_id, points, 8 - (f_dx + f_named + f_dur + f_img + f_lim + f_app + f_cpt + f_sym) AS fixes, len(kept) + coalesce(h.n, 0) AS risks,
      len(list_filter(kept, lambda x: x.id = 'f-9')) AS done
      FROM earned e JOIN f ON f.case_id = e.case_id LEFT JOIN h ON h.case_id = e.case_id)
SELECT case_id, fixes, risks, fixes + risks - done AS open_count, format('{{:.1f}}', points / 10) AS display,
  CASE WHEN points >= 80 THEN CASE WHEN fixes + risks - done > 0 THEN 'Strong — clear the open items' ELSE 'Ready to submit' END
       WHEN points >= 50 THEN 'Moderate — address gaps before submitting' ELSE 'High denial risk — major gaps' END AS band FROM a""")
def attention_items(spark, sf):
    listed = sc.attention_items(cases(spark, sf), F.array(F.lit("f-9")))
    points = sc.earned_weight(F.col("strength"))
    n = lambda kind: F.size(F.filter("items", lambda i: i["kind"] == kind)).cast("bigint")
    return listed.select("case_id", n("fix").alias("fixes"), n("risk").alias("risks"), F.col("open_count").cast("bigint").alias("open_count"),
                         sc.display_score(points).alias("display"), sc.display_band(points, F.col("open_count")).alias("band"))


# ---- payer rules ----------------------------------------------------------------

@query("payer_matching", f"WITH {o.PARSED}, {o.RULES} SELECT case_id, case_payer_id FROM raw_extractions JOIN payer ON p = payer_name")
def payer_matching(spark, sf):
    return bound(spark, sf, "raw_extractions").select("case_id", rl.payer_id_of("payer_name").alias("case_payer_id"))


@query("rule_matching", f"WITH {o.RULED} SELECT case_id, case_payer_id, rule_cpt, status AS validation_status FROM ruled")
def rule_matching(spark, sf):
    return rl.with_rule(records(spark, sf), rl.load_rules(spark)).select("case_id", "case_payer_id", "rule_cpt", "validation_status")


@query("validated_rule_gate", f"WITH {o.RULED} SELECT case_id, rule_payer_name FROM ruled WHERE status = 'validated'")
def validated_rule_gate(spark, sf):
    """Rules are filtered before the join, so unvalidated ones never reach a case."""
    gated = rl.load_rules(spark).where(rl.is_validated())
    return rl.with_rule(records(spark, sf), gated).where("rule_cpt IS NOT NULL").select("case_id", "rule_payer_name")


@query("known_cpt", f"WITH {o.PARSED} SELECT cpt_code, trim(cpt_code) IN ({o.KNOWN}) AS known, count(*) AS n FROM raw_extractions GROUP BY 1, 2")
def known_cpt(spark, sf):
    return bound(spark, sf, "raw_extractions").groupBy("cpt_code", sc.known_cpt(F.col("cpt_code")).alias("known")).agg(F.count("*").alias("n"))


@query("treatment_weeks", f"WITH {o.RULED} SELECT case_id, have AS therapy_weeks, need AS required_weeks, penalized FROM final")
def treatment_weeks(spark, sf):
    ruled = rl.with_rule(records(spark, sf), rl.load_rules(spark))
    therapy = F.filter("requirements", lambda r: tx.contains(F.lower(r["treatment"]), F.lit("physical therapy")))
    need = F.coalesce(tx.payer_weeks(F.get(therapy, F.lit(0))["minimum_duration"]), F.lit(0))
    have = rl.therapy_weeks(F.col("treatments"))
    return ruled.select("case_id", have.alias("therapy_weeks"), need.alias("required_weeks"),
                        (rl.is_validated() & (need > 0) & (have > 0) & (have < need)).alias("penalized"))


@query("duration_penalty", f"""WITH {o.RULED}
SELECT case_id, f_dur AS score, CASE WHEN penalized THEN rule_payer_name || ' requires ≥' || need || ' weeks PT. Chart shows ' || have || ' week' || CASE WHEN have = 1 THEN '' ELSE 's' END || '.' END AS penalty_note
FROM earned""")
def duration_penalty(spark, sf):
    part = F.col("strength.conservative_treatment_duration")
    return cases(spark, sf).select("case_id", part["score"].alias("score"), F.when(part["note"].contains(" weeks PT. Chart shows "), part["note"]).alias("penalty_note"))


@query("payer_checklist", f"WITH {o.RULED} SELECT case_id, pos, label, requirement, hard, verdict FROM checked")
def payer_checklist(spark, sf):
    listed = cases(spark, sf).select("case_id", F.posexplode("checklist").alias("pos", "c"))
    return listed.select("case_id", F.col("pos").cast("bigint").alias("pos"), "c.*")


@query("hard_requirement_flags", f"""WITH {o.RULED},
f AS (SELECT case_id, list_transform(list_filter(risk_flags, lambda f: NOT starts_with(f.id, 'payer-hardreq-')), lambda x: x.label) AS labels FROM earned)
SELECT c.case_id, 'payer-hardreq-' || c.pos AS id, 'Payer requirement not confirmed: ' || c.label AS label
FROM checked c JOIN f ON f.case_id = c.case_id WHERE c.hard AND c.verdict = 'not_met' AND NOT list_contains(f.labels, 'Payer requirement not confirmed: ' || c.label)""")
def hard_requirement_flags(spark, sf):
    return cases(spark, sf).select("case_id", F.explode("new_flags").alias("f")).select("case_id", "f.id", "f.label")


@query("flag_refresh", f"""WITH {o.RULED},
f AS (SELECT case_id, list_filter(risk_flags, lambda f: NOT starts_with(f.id, 'payer-hardreq-')) AS kept FROM earned),
h AS (SELECT c.case_id, string_agg('payer-hardreq-' || c.pos, '|' ORDER BY c.pos) AS ids FROM checked c JOIN f ON f.case_id = c.case_id
      WHERE c.hard AND c.verdict = 'not_met' AND NOT list_contains(list_transform(f.kept, lambda x: x.label), 'Payer requirement not confirmed: ' || c.label) GROUP BY 1)
SELECT f.case_id, concat_ws('|', nullif(array_to_string(list_transform(kept, lambda x: x.id), '|'), ''), ids) AS ids FROM f LEFT JOIN h ON h.case_id = f.case_id""")
def flag_refresh(spark, sf):
    return cases(spark, sf).select("case_id", joined(F.transform("risk_flags", lambda f: f["id"])).alias("ids"))


@query("rule_status_rollup", f"""WITH {o.RULED}
SELECT CASE WHEN rule_cpt IS NULL THEN 'no rule' WHEN status = 'validated' THEN 'validated' WHEN case_payer_id = 'aetna' AND rule_cpt = '29827' THEN 'no primary source'
            WHEN case_payer_id = 'uhc' THEN 'licensed source' ELSE 'unaccounted' END AS state, count(*) AS n,
       count(DISTINCT case_payer_id || rule_cpt) AS rules FROM ruled GROUP BY 1""")
def rule_status_rollup(spark, sf):
    return rl.status_rollup(rl.with_rule(records(spark, sf), rl.load_rules(spark)))


@query("rule_violations", f"WITH {o.PARSED}, {o.RULES} SELECT case_id, '-' AS violation FROM raw_extractions WHERE false")
def rule_violations(spark, sf):
    """Cases that would be judged by a rule that breaks the validation gate: none may exist."""
    broken = rl.violations(rl.load_rules(spark)).select(F.col("payer_id").alias("case_payer_id"), F.col("rule_cpt").alias("cpt_code"), "violation")
    matched = bound(spark, sf, "raw_extractions").select("case_id", "cpt_code", rl.payer_id_of("payer_name").alias("case_payer_id"))
    return matched.join(broken, ["case_payer_id", "cpt_code"]).select("case_id", "violation")


@query("requirement_phrases", f"""WITH {o.RULED}
SELECT case_id, pos, label, array_to_string({o.phrases('label')}, '|') AS phrases FROM needed""")
def requirement_phrases(spark, sf):
    ruled = rl.with_rule(records(spark, sf), rl.load_rules(spark)).select("case_id", F.posexplode("requirements").alias("pos", "r"))
    return ruled.select("case_id", F.col("pos").cast("bigint").alias("pos"), F.col("r.treatment").alias("label"), joined(rl.candidate_phrases(F.col("r.treatment"))).alias("phrases"))


@query("requirement_matches", f"""WITH {o.RULED}
SELECT case_id, pos, array_to_string(list_transform({o._matches('label')}, lambda t: t.treatment), '|') AS matched FROM needed""")
def requirement_matches(spark, sf):
    ruled = rl.with_rule(records(spark, sf), rl.load_rules(spark)).select("case_id", "treatments", F.posexplode("requirements").alias("pos", "r"))
    found = rl.matching_treatments(F.col("r.treatment"), F.col("treatments"))
    return ruled.select("case_id", F.col("pos").cast("bigint").alias("pos"), joined(F.transform(found, lambda t: t["treatment"])).alias("matched"))


@query("criteria_text", f"""WITH {o.RULED}
SELECT case_id, status = 'validated' AND rule_cpt IS NOT NULL AS has_text, CASE WHEN status = 'validated' THEN len(needs) END AS care_lines FROM ruled WHERE rule_cpt IS NOT NULL""")
def criteria_text(spark, sf):
    ruled = rl.with_rule(records(spark, sf), rl.load_rules(spark)).where("rule_cpt IS NOT NULL").withColumn("block", rl.criteria_text())
    care = F.regexp_extract("block", r"(?s)CONSERVATIVE CARE MINIMUMS:\n(.*?)\n\n", 1)
    return ruled.select("case_id", F.col("block").isNotNull().alias("has_text"),
                        F.when(F.col("block").isNotNull(), F.size(F.split(care, "\n"))).cast("bigint").alias("care_lines"))


@query("appeal_citations", f"""WITH {o.RULED}
SELECT case_id, coalesce(status = 'validated', false) AS may_cite, CASE WHEN status = 'validated' THEN len(functional) ELSE 0 END AS citations FROM ruled""")
def appeal_citations(spark, sf):
    ruled = rl.with_rule(records(spark, sf), rl.load_rules(spark))
    kept = rl.allowed_citations(F.col("functional_criteria"))
    return ruled.select("case_id", rl.is_validated().alias("may_cite"), F.size(kept).cast("bigint").alias("citations"))


# ---- supplements -------------------------------------------------------------------

def fixed_records(spark, sf):
    given = nz.supplement_map(bound(spark, sf, "supplements"))
    return nz.merged(records(spark, sf).join(keyed(given), "case_id", "left"))


_SUP = f"""{o.NORM}, {cte('supplements')},
sup AS (SELECT case_id, arg_max(trim(value), seq) FILTER (WHERE key = 'symptom_duration') AS s_sym, arg_max(trim(value), seq) FILTER (WHERE key = 'surgical_approach') AS s_app,
   arg_max(trim(value), seq) FILTER (WHERE key = 'diagnosis_codes') AS s_dx, arg_max(trim(value), seq) FILTER (WHERE key = 'functional_limitations') AS s_lim,
   arg_max(trim(value), seq) FILTER (WHERE key = 'imaging_findings') AS s_img, arg_max(trim(value), seq) FILTER (WHERE key = 'conservative_treatments_named') AS s_named,
   arg_max(trim(value), seq) FILTER (WHERE key = 'conservative_treatment_duration') AS s_dur, arg_max(trim(value), seq) FILTER (WHERE key = 'cpt_code_valid') AS s_cpt
   FROM supplements GROUP BY 1),
m AS (SELECT norm.*, sup.* EXCLUDE (case_id) FROM norm LEFT JOIN sup ON sup.case_id = norm.case_id)"""


def _append(field, s):
    return f"CASE WHEN {s} IS NULL THEN {field} WHEN {field} IS NULL THEN {s} ELSE {field} || '; physician-supplied clarification: ' || {s} END"


def _push(field, s):
    return f"CASE WHEN {s} IS NULL OR list_contains(list_transform({field}, lambda e: lower(e)), lower({s})) THEN {field} ELSE list_append({field}, {s}) END"


@query("supplement_merge", f"""WITH {_SUP}
SELECT case_id, {_append('symptom_duration', 's_sym')} AS symptom_duration, {_append('surgical_approach', 's_app')} AS surgical_approach,
  array_to_string({_push('diagnosis_codes', 's_dx')}, '|') AS diagnosis_codes, array_to_string({_push('functional_limitations', 's_lim')}, '|') AS functional_limitations,
  {_append('findings', 's_img')} AS findings, modality,
  len(treatments) + CASE WHEN s_named IS NULL THEN 0 ELSE 1 END + CASE WHEN s_dur IS NOT NULL AND s_named IS NULL THEN 1 ELSE 0 END AS treatments,
  CASE WHEN s_dur IS NOT NULL THEN s_dur WHEN s_named IS NOT NULL THEN NULL ELSE treatments[len(treatments)].duration END AS last_duration FROM m""")
def supplement_merge(spark, sf):
    fixed = fixed_records(spark, sf)
    return fixed.select("case_id", "symptom_duration", "surgical_approach", joined("diagnosis_codes").alias("diagnosis_codes"),
                        joined("functional_limitations").alias("functional_limitations"), F.col("imaging.key_findings").alias("findings"), "imaging.modality",
                        F.size("treatments").cast("bigint").alias("treatments"),
                        F.when(F.size("treatments") > 0, F.element_at("treatments", -1)["duration"]).alias("last_duration"))


@query("cpt_correction", f"""WITH {_SUP}, c AS (SELECT *, nullif(regexp_extract(s_cpt, '\\d{{5}}'), '') AS code FROM m)
SELECT case_id, CASE WHEN code IN ({o.KNOWN}) AND code <> cpt_code THEN code ELSE cpt_code END AS cpt_code,
       'CPT ' || CASE WHEN code IN ({o.KNOWN}) AND code <> cpt_code THEN code ELSE cpt_code END || ', not ' || cpt_code || '1' AS letter FROM c""")
def cpt_correction(spark, sf):
    fixed = fixed_records(spark, sf).withColumn("new_cpt", rl.corrected_cpt(F.col("supplements")["cpt_code_valid"], F.col("cpt_code")))
    letter = F.concat(F.lit("CPT "), F.col("cpt_code"), F.lit(", not "), F.col("cpt_code"), F.lit("1"))
    return fixed.select("case_id", F.col("new_cpt").alias("cpt_code"), rl.letter_with_cpt(letter, F.col("cpt_code"), F.col("new_cpt")).alias("letter"))


@query("warning_resolutions", f"""WITH {_SUP}
SELECT case_id, '- Imaging findings: User has confirmed this is addressed.' AS lines FROM m WHERE s_img IS NOT NULL""")
def warning_resolutions(spark, sf):
    """A supplied finding resolves the imaging warning."""
    fixed = fixed_records(spark, sf).where(F.col("supplements")["imaging_findings"].isNotNull())
    state = F.create_map(F.lit("imaging_findings"), F.lit("resolved"), F.lit("functional_limitations"), F.lit("open"))
    return fixed.select("case_id", nz.resolution_lines(state).alias("lines"))


@query("patient_name_hash", f"WITH {o.NORM} SELECT case_id, {o.keyed_hash('patient_name', HASH_KEY)} AS patient_name_hash FROM norm WHERE patient_name IS NOT NULL")
def patient_name_hash(spark, sf):
    return records(spark, sf).where("patient_name IS NOT NULL").select("case_id", tx.keyed_hash("patient_name", HASH_KEY).alias("patient_name_hash"))


@query("packet_fields", f"""WITH {o.NORM}
SELECT case_id, coalesce(nullif(lower(regexp_replace(regexp_replace(patient_name, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g')), ''), 'patient') || '-pa-packet-cpt-' || cpt_code || '.docx' AS file_name,
  CASE WHEN modality IS NULL AND findings IS NULL THEN 'Pending' ELSE 'Included' END AS imaging_reports,
  CASE WHEN len(treatments) = 0 THEN 'Pending' ELSE 'Included' END AS care_notes FROM norm WHERE patient_name IS NOT NULL""")
def packet_fields(spark, sf):
    named = records(spark, sf).where("patient_name IS NOT NULL")
    state = lambda missing: F.when(missing, "Pending").otherwise("Included")
    return named.select("case_id", tx.packet_file_name("patient_name", "cpt_code").alias("file_name"),
                        state(F.col("imaging").isNull()).alias("imaging_reports"), state(F.size("treatments") == 0).alias("care_notes"))
