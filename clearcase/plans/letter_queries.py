"""Queries over letters, grounding and evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearcase import fixed_values as fv
from clearcase.bindings import bound, cte
from clearcase.functions import text as tx
from clearcase.operators import deid
from clearcase.operators import evals as evl
from clearcase.operators import grounding as gr
from clearcase.operators import letters as lt
from clearcase.operators import normalize as nz
from clearcase.operators import scoring as sc
from clearcase.plans import case_oracle as o
from clearcase.plans.case_queries import joined, records
from clearcase.plans.deid_queries import lit
from clearcase.plans.registry import query
from clearcase.sources.tables import keyed, missing_runs, settled

_MON = "(?:" + "|".join(m for m in fv.MONTH_NAMES if m != "Sept") + ")"
LETTER_DATES = [r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", rf"(?i)\b{_MON}\.?\s+\d{{1,2}},?\s+\d{{4}}\b", rf"(?i)\b{_MON}\.?\s+\d{{4}}\b",
                r"(?i)\b(?:late|early)\s+\d{4}\b", r"(?i)\b\d+\s?(?:day|week|month|year)s?\b"]
RECORD_DATES = LETTER_DATES[:2] + [r"\b\d{1,2}/\d{4}\b"] + LETTER_DATES[2:4]


def canon(v: str) -> str:
    """canonical date in DuckDB."""
    months = "CASE lower({m}) " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in fv.MONTH_NUMBERS.items()) + " END"
    long, short = r"'^([A-Za-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})$'", r"'^([A-Za-z]+)\.?\s+(\d{4})$'"
    full, my = r"'^(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})$'", r"'^(\d{1,2})/(\d{4})$'"
    x = lambda p, i: f"regexp_extract({v}, {p}, {i})"
    year = f"CASE WHEN len({x(full, 3)}) = 2 THEN '20' || {x(full, 3)} ELSE {x(full, 3)} END"
    return (f"CASE WHEN regexp_matches({v}, {long}) THEN {x(long, 3)} || '-' || {months.format(m=x(long, 1))} || '-' || lpad({x(long, 2)}, 2, '0') "
            f"WHEN regexp_matches({v}, {short}) THEN {x(short, 2)} || '-' || {months.format(m=x(short, 1))} "
            f"WHEN regexp_matches({v}, {full}) THEN {year} || '-' || lpad({x(full, 1)}, 2, '0') || '-' || lpad({x(full, 2)}, 2, '0') "
            f"WHEN regexp_matches({v}, {my}) THEN {x(my, 2)} || '-' || lpad({x(my, 1)}, 2, '0') END")


def find(text: str, patterns: list[str]) -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all({text}, {lit(p)})" for p in patterns) + "])"


_FACTS = """concat_ws('|', patient_name, date_of_birth, array_to_string(diagnosis_codes, '|'), primary_complaint, symptom_duration,
 array_to_string(functional_limitations, '|'), array_to_string(objective_measurements, '|'),
 array_to_string(list_transform(treatments, lambda t: concat_ws('|', t.treatment, t.duration, t.outcome, t.dates, t.relief_duration)), '|'),
 modality, findings, imaging_status, requested_procedure, surgical_approach, pain_score, asa_classification)"""
LETTERS = f"""{o.NORM}, {cte('drafts')}, l AS (SELECT d.case_id, d.attempt, d.letter_date, d.text AS letter, {_FACTS} AS facts, norm.* EXCLUDE (case_id)
  FROM drafts d JOIN norm ON norm.case_id = d.case_id)"""


def letters(spark, sf):
    facts = gr.with_date_facts(records(spark, sf).withColumn("facts", nz.clinical_json()), "facts", "fact_dates")
    return bound(spark, sf, "drafts").withColumnRenamed("text", "letter").join(keyed(facts), "case_id")


@query("canonical_dates", f"""WITH {cte('charts')}, v AS (SELECT chart_id, unnest({find('text', RECORD_DATES)}) AS raw FROM charts)
SELECT chart_id, raw, {canon('raw')} AS canonical FROM v""")
def canonical_dates(spark, sf):
    found = bound(spark, sf, "charts").select("chart_id", F.explode(tx.find_all("text", *tx.RECORD_DATES)).alias("raw"))
    return found.withColumn("canonical", tx.canonical_date("raw"))


@query("letter_ungrounded_dates", f"""WITH {LETTERS},
c AS (SELECT case_id, attempt, letter_date, facts, unnest({find('letter', LETTER_DATES)}) AS claim, list_transform({find('facts', RECORD_DATES)}, lambda x: {canon('x')}) AS known FROM l)
SELECT case_id, attempt, claim FROM c WHERE claim <> letter_date AND NOT contains(facts, claim) AND NOT coalesce(list_contains(known, {canon('claim')}), false)""")
def letter_ungrounded_dates(spark, sf):
    checked = gr.ungrounded_dates(letters(spark, sf), "letter", "facts", "letter_date")
    return tx.each(checked, F.col("dates_missing"), "claim", "case_id", "attempt")


_TERMS = ", ".join(f"'{t}'" for t in fv.HIGH_RISK_TERMS)


@query("letter_ungrounded_terms", f"""WITH {LETTERS}
SELECT case_id, attempt, t AS term FROM l CROSS JOIN (SELECT unnest([{_TERMS}]) AS t) WHERE contains(lower(letter), lower(t)) AND NOT contains(lower(facts), lower(t))""")
def letter_ungrounded_terms(spark, sf):
    return tx.each(letters(spark, sf), gr.terms_missing(F.col("letter"), F.col("facts")), "term", "case_id", "attempt")


@query("letter_ungrounded_doses", f"""WITH {LETTERS}, d AS (SELECT case_id, attempt, facts, unnest(regexp_extract_all(letter, '(?i)\\b\\d+\\s?mg\\b')) AS dose FROM l)
SELECT case_id, attempt, dose FROM d WHERE NOT contains(facts, dose)""")
def letter_ungrounded_doses(spark, sf):
    return tx.each(letters(spark, sf), gr.doses_missing(F.col("letter"), F.col("facts")), "dose", "case_id", "attempt")


_WORDS = lambda v: f"list_distinct(list_filter(regexp_split_to_array({v}, '\\s+'), lambda w: length(w) > 3))"
_CLAIM = " UNION ALL ".join(
    f"SELECT case_id, attempt, functional_limitations, s, unnest(regexp_extract_all(s, {lit(p)})) AS m, unnest(regexp_extract_all(s, {lit(p)}, 1)) AS c FROM k" for p in gr.LIMITATION_CLAIMS)


@query("letter_ungrounded_limitations", f"""WITH {LETTERS},
s AS (SELECT case_id, attempt, functional_limitations, trim(unnest(regexp_split_to_array(regexp_replace(regexp_replace(letter, '\\n+', ' ', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))) AS s FROM l),
k AS (SELECT * FROM s WHERE s <> '' AND NOT regexp_matches(s, '(?i)activities of daily living')),
c AS (SELECT *, lower(trim(c)) AS claim FROM ({_CLAIM})),
u AS (SELECT * FROM c WHERE len(list_filter(functional_limitations, lambda a: contains(lower(a), left(claim, 15)) OR contains(claim, left(lower(a), 15))
  OR len(list_intersect({_WORDS('claim')}, {_WORDS('lower(a)')})) >= 2)) = 0)
SELECT DISTINCT case_id, attempt, '"' || trim(m) || '"  (sentence: ' || s || ')' AS claim FROM u""")
def letter_ungrounded_limitations(spark, sf):
    checked = gr.ungrounded_limitations(letters(spark, sf), "letter", "functional_limitations")
    return tx.each(checked, F.col("limitations_missing"), "claim", "case_id", "attempt")


@query("letter_source_lock")
def letter_source_lock(spark, sf):
    """Letters with violations and whether they may be exported once confirmed."""
    checked = gr.source_lock(letters(spark, sf))
    return checked.select("case_id", "attempt", F.size("violations").alias("violations"),
                          lt.export_gate(F.col("letter_date"), F.col("violations"), F.col("case_id") % 2 == 0).alias("blocked_by"))


_PEND = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, 'mri|x-ray|xray|ct scan|imaging') AND regexp_matches(s, 'pending|scheduled|awaiting|not yet|to be scheduled|ordered but'))"


@query("chart_pending_imaging", f"WITH {cte('charts')} SELECT chart_id, len({_PEND}) > 0 AS pending FROM charts")
def chart_pending_imaging(spark, sf):
    return bound(spark, sf, "charts").select("chart_id", gr.has_pending_imaging("text").alias("pending"))


DISCREPANCIES = f"""WITH {o.NORM}, {cte('charts')},
j AS (SELECT norm.*, c.text, list_transform({find('c.text', RECORD_DATES)}, lambda x: {canon('x')}) AS known FROM norm JOIN charts c ON c.chart_id = norm.chart_id),
k AS (SELECT case_id, text, known, t.treatment AS treatment, unnest({find('t.dates', RECORD_DATES)}) AS d FROM (SELECT *, unnest(treatments) AS t FROM j) WHERE t.dates <> 'Not documented')
SELECT case_id, 'date of birth: ' || date_of_birth AS discrepancy FROM j WHERE NOT contains(text, date_of_birth) AND NOT coalesce(list_contains(known, {canon('date_of_birth')}), false)
UNION ALL SELECT case_id, 'diagnosis code: ' || c FROM (SELECT case_id, text, unnest(diagnosis_codes) AS c FROM j) WHERE NOT contains(lower(text), lower(c))
UNION ALL SELECT case_id, 'treatment date: ' || d || ' of ' || treatment FROM k WHERE NOT contains(text, d) AND NOT coalesce(list_contains(known, {canon('d')}), false)
UNION ALL SELECT case_id, 'imaging may be pending' FROM j WHERE imaging_status = 'completed' AND len({_PEND}) > 0"""


@query("record_chart_discrepancies", DISCREPANCIES)
def record_chart_discrepancies(spark, sf):
    charts = bound(spark, sf, "charts").select("chart_id", F.col("text").alias("chart_text"))
    checked = gr.record_against_chart(records(spark, sf).join(keyed(charts), "chart_id"))
    return tx.each(checked, F.col("discrepancies"), "discrepancy", "case_id")


@query("letter_evaluation_checks")
def letter_evaluation_checks(spark, sf):
    checked = gr.evaluation_violations(letters(spark, sf))
    return tx.each(checked, F.col("eval_violations"), "v", "case_id", "attempt").select("case_id", "attempt", "v.sentence", "v.reason")


@query("letter_combined_verdict")
def letter_combined_verdict(spark, sf):
    checked = settled(gr.evaluation_violations(letters(spark, sf)))
    both = gr.combined_violations(gr.source_lock(checked))
    return both.select("case_id", "attempt", F.size("all_violations").alias("violations"))


# ---- clean-up --------------------------------------------------------------------

@query("letter_absence_language", f"""WITH {cte('drafts')},
p AS (SELECT case_id, attempt, text, {'regexp_replace(' * 8}text{''.join(f", '{x}', 'was not available for review', 'gi')" for x in lt.ABSENCE_PHRASES)} AS t FROM drafts),
q AS (SELECT *, regexp_replace(t, '[^.!?\\n]*was not available for review[^.!?\\n]*[.!?]', '', 'gi') AS u FROM p)
SELECT case_id, attempt, CASE WHEN u = text THEN text ELSE regexp_replace(regexp_replace(regexp_replace(u, '[ \\t]{{2,}}', ' ', 'g'), '[ \\t]+([.!?,])', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') END AS letter FROM q""")
def letter_absence_language(spark, sf):
    return bound(spark, sf, "drafts").select("case_id", "attempt", lt.without_absence_language(F.col("text")).alias("letter"))


@query("letter_bmi_asa", f"""WITH {LETTERS}, b AS (SELECT *, {"CASE WHEN bmi = floor(bmi) THEN CAST(CAST(bmi AS BIGINT) AS VARCHAR) ELSE CAST(bmi AS VARCHAR) END"} AS shown FROM l),
s AS (SELECT *, CASE WHEN bmi >= 30 THEN regexp_replace(letter, '(?i)(CLINICAL HISTORY AND PRESENTING COMPLAINT\\s*\\n+[^.!?]+[.!?])', '\\1 The patient has a documented BMI of ' || shown || ', ' ||
    CASE WHEN bmi >= 40 THEN 'Class III' WHEN bmi >= 35 THEN 'Class II' ELSE 'Class I' END || ' obesity, which represents a significant contributor to articular cartilage loading and disease progression.')
  WHEN bmi >= 25 AND asa_classification IS NOT NULL THEN regexp_replace(letter, '(?i)(REQUESTED PROCEDURE\\s*\\n+)', '\\1The patient''s BMI of ' || shown || ' and ASA ' || asa_classification || ' classification have been factored into the perioperative surgical plan. ')
  ELSE letter END AS w FROM b)
SELECT case_id, attempt, CASE WHEN asa_classification IS NOT NULL AND NOT regexp_matches(w, '(?i)\\bASA\\b') THEN regexp_replace(w, '(?i)(REQUESTED PROCEDURE\\s*\\n+)',
   '\\1The patient carries an ASA ' || asa_classification || ' classification, reflecting the anesthetic risk profile accounted for in the perioperative surgical plan. ') ELSE w END AS letter FROM s""")
def letter_bmi_asa(spark, sf):
    return letters(spark, sf).select("case_id", "attempt", lt.with_bmi_and_asa(F.col("letter")).alias("letter"))


@query("letter_duplicate_drafts")
def letter_duplicate_drafts(spark, sf):
    cut, doubled = lt.duplicate_removed(F.col("text"))
    return bound(spark, sf, "drafts").select("case_id", "attempt", cut.alias("letter"), doubled.alias("duplicate_removed"))


_KEPT = """trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(replace({t}, '[REQUIRES PHYSICIAN REVIEW — IMAGING PENDING]', '__M__'), chr(10)),
  lambda x: NOT regexp_matches(x, '\\[[^\\]]+\\]')), chr(10)), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ')"""


@query("letter_bracket_lines", f"""WITH {cte('drafts')} SELECT case_id, attempt, replace({_KEPT.format(t='text')}, '__M__', '[REQUIRES PHYSICIAN REVIEW — IMAGING PENDING]') AS letter FROM drafts""")
def letter_bracket_lines(spark, sf):
    return bound(spark, sf, "drafts").select("case_id", "attempt", lt.without_bracket_lines(F.col("text")).alias("letter"))


@query("letter_signature", f"""WITH {LETTERS}, c AS (SELECT *, lower(array_to_string(string_split(letter, chr(10))[-12:], chr(10))) AS tail, trim(regexp_replace(provider_name, '(?i)^Dr\\.\\s*', '')) AS bare FROM l)
SELECT case_id, attempt, CASE WHEN contains(tail, lower(bare)) AND coalesce(contains(tail, lower(practice_name)), true) THEN letter
  ELSE letter || chr(10) || chr(10) || concat_ws(chr(10), 'Sincerely,', CASE WHEN regexp_matches(bare, '(?i)\\bM\\.?D\\.?\\b|\\bD\\.?O\\.?\\b') THEN bare ELSE bare || ', MD' END, practice_name) END AS letter FROM c""")
def letter_signature(spark, sf):
    return letters(spark, sf).select("case_id", "attempt", lt.with_signature(F.col("letter")).alias("letter"))


@query("letter_heading", f"""WITH {cte('drafts')}
SELECT case_id, attempt, trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '(?i)^[#*\\s]*letter of medical necessity[#*\\s]*$')), chr(10)),
  '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS letter FROM drafts""")
def letter_heading(spark, sf):
    return bound(spark, sf, "drafts").select("case_id", "attempt", lt.without_heading(F.col("text")).alias("letter"))


@query("letter_placeholders")
def letter_placeholders(spark, sf):
    return lt.filled(letters(spark, sf)).select("case_id", "attempt", "letter")


@query("letter_sections", f"""WITH {cte('drafts')}
SELECT case_id, attempt, CASE WHEN contains(text, 'FUNCTIONAL LIMITATIONS') THEN trim(split_part(substr(text, instr(text, 'FUNCTIONAL LIMITATIONS')), 'CONSERVATIVE TREATMENT HISTORY', 1), chr(10) || ' ') ELSE '' END AS limitations,
  CASE WHEN contains(text, 'MEDICAL NECESSITY SUMMARY') THEN trim(substr(text, instr(text, 'MEDICAL NECESSITY SUMMARY')), chr(10) || ' ') ELSE '' END AS summary FROM drafts""")
def letter_sections(spark, sf):
    return bound(spark, sf, "drafts").select(
        "case_id", "attempt", tx.section("text", "FUNCTIONAL LIMITATIONS", "CONSERVATIVE TREATMENT HISTORY").alias("limitations"),
        tx.section("text", "MEDICAL NECESSITY SUMMARY").alias("summary"))


@query("letter_changed_paragraphs", f"""WITH {cte('drafts')},
p AS (SELECT case_id, attempt, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS paragraph FROM (SELECT case_id, attempt, regexp_split_to_array(text, '\\n\\n+') AS s FROM drafts))
SELECT n.case_id, n.pos, n.paragraph IS DISTINCT FROM v.paragraph AS changed FROM p n LEFT JOIN p v ON v.case_id = n.case_id AND v.pos = n.pos AND v.attempt = 1 WHERE n.attempt = 2""")
def letter_changed_paragraphs(spark, sf):
    drafts = bound(spark, sf, "drafts").withColumnRenamed("text", "letter")
    both = lt.changed_paragraphs(drafts.where("attempt = 1"), drafts.where("attempt = 2"), "case_id")
    return both.select("case_id", F.col("pos").cast("bigint").alias("pos"), "changed")


@query("letter_anchor_runs")
def letter_anchor_runs(spark, sf):
    marks = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(a).alias("anchor")) for i, a in
                      (("history", "CLINICAL HISTORY"), ("complaint", "HISTORY AND PRESENTING COMPLAINT"), ("limits", "FUNCTIONAL LIMITATIONS"), ("mri", "MRI"))])
    runs = bound(spark, sf, "drafts").select("case_id", "attempt", F.explode(lt.anchor_runs(F.col("text"), marks)).alias("r"))
    return runs.select("case_id", "attempt", "r.*")


@query("letter_finalize")
def letter_finalize(spark, sf):
    """Both drafts checked, one chosen per case, filled and signed."""
    facts = records(spark, sf).withColumn("facts", nz.clinical_json())
    done = lt.finalized(bound(spark, sf, "drafts"), facts)
    return done.select("case_id", "attempt", "letter", F.size("warnings").alias("warnings"))


@query("letter_restored_tokens", f"""WITH {cte('drafts')} SELECT case_id, attempt, replace(replace(text, '[Patient Name]', 'Ann Lee'), '[DATE]', '2024-05-01') AS letter FROM drafts""")
def letter_restored_tokens(spark, sf):
    """Literal replacement of tokens by values, longest token first."""
    entries = [("[DATE]", "2024-05-01"), ("[Patient Name]", "Ann Lee")]
    toks = F.array(*[F.struct(F.lit("x").alias("cat"), F.lit(1).alias("n"), F.lit(t).alias("token"), F.lit(v).alias("raw"), F.lit("").alias("key")) for t, v in entries])
    return bound(spark, sf, "drafts").select("case_id", "attempt", deid.reidentified(F.col("text"), toks).alias("letter"))


# ---- evaluation -------------------------------------------------------------------

def _expectations(spark, sf):
    base = bound(spark, sf, "raw_extractions").select("case_id")
    row = lambda f, k, t, codes, n: F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.lit(t).cast("string").alias("expected_text"),
                                             F.array(*[F.lit(c) for c in codes]).cast("array<string>").alias("expected_codes"), F.lit(n).cast("int").alias("expected_num"))
    rows = [row("date_of_birth", "exact", "05/05/1961", [], None), row("diagnosis_codes", "must_include", None, ["M17.11", "M17.12"], None),
            row("requested_procedure", "contains_ci", "total knee", [], None), row("treatments", "min_count", None, [], 2),
            row("imaging", "present", "x-ray", [], 1), row("strength.symptom_duration", "score", None, [], 1)]
    return base.select("case_id", F.inline(F.array(*rows)))


_CHECKS = f"""WITH {o.SCORED}, k AS (SELECT case_id, unnest([{{'field': 'date_of_birth', 'passed': date_of_birth = '05/05/1961'}},
  {{'field': 'diagnosis_codes', 'passed': list_contains(diagnosis_codes, 'M17.11') AND list_contains(diagnosis_codes, 'M17.12')}},
  {{'field': 'requested_procedure', 'passed': contains(lower(coalesce(requested_procedure, '(null)')), 'total knee')}}, {{'field': 'treatments', 'passed': len(treatments) >= 2}},
  {{'field': 'imaging', 'passed': (modality IS NOT NULL OR findings IS NOT NULL) AND coalesce(contains(lower(modality), 'x-ray'), true)}},
  {{'field': 'strength.symptom_duration', 'passed': f_sym = 1}}], recursive := true) FROM scored)
"""


@query("expectation_checks", _CHECKS + "SELECT case_id, field, passed FROM k")
def expectation_checks(spark, sf):
    return evl.compared(sc.scored(records(spark, sf)), _expectations(spark, sf)).select("case_id", "field", "passed")


@query("expectation_summary", _CHECKS + """SELECT case_id, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
  coalesce(string_agg(field, ',' ORDER BY field) FILTER (NOT passed), '') AS failures FROM k GROUP BY 1""")
def expectation_summary(spark, sf):
    return evl.summarized(evl.compared(sc.scored(records(spark, sf)), _expectations(spark, sf)))


@query("missing_codes", f"""WITH {o.NORM} SELECT case_id, array_to_string(list_filter(['M17.11', 'M17.12'], lambda c: NOT list_contains(diagnosis_codes, c)), ',') AS missing FROM norm""")
def missing_codes(spark, sf):
    return records(spark, sf).select("case_id", joined(F.array_except(F.array(F.lit("M17.11"), F.lit("M17.12")), "diagnosis_codes"), ",").alias("missing"))


_RUNS = f"""WITH {cte('eval_runs')}, r AS (SELECT *, row_number() OVER (PARTITION BY fixture, route ORDER BY run, failed) AS pos FROM eval_runs),
e AS (SELECT *, max(CASE WHEN pos <= 5 THEN failed END) OVER (PARTITION BY fixture, route) = 1 AS escalated FROM r),
c AS (SELECT * FROM e WHERE pos <= 5 OR (escalated AND pos <= 10))
"""


@query("eval_counted_runs", _RUNS + "SELECT fixture, route, run, failed, escalated FROM c")
def eval_counted_runs(spark, sf):
    return evl.counted_runs(bound(spark, sf, "eval_runs")).select("fixture", "route", "run", "failed", "escalated")


@query("eval_pass_rates", _RUNS + """SELECT fixture, route, count(*) AS runs, count(*) FILTER (failed = 0) AS passes, grouping_id(fixture, route) AS level,
  CAST(floor(count(*) FILTER (failed = 0) / count(*) * 100 + 0.5) AS BIGINT) AS pass_pct FROM c GROUP BY ROLLUP (fixture, route)""")
def eval_pass_rates(spark, sf):
    return evl.pass_rates(evl.counted_runs(bound(spark, sf, "eval_runs")))


@query("eval_baselines", f"WITH {cte('eval_runs')} SELECT fixture, arg_min(case_id, run) AS case_id, min(run) AS run FROM eval_runs WHERE failed = 0 GROUP BY 1")
def eval_baselines(spark, sf):
    return evl.baselines(bound(spark, sf, "eval_runs"))


@query("eval_cost", f"""WITH {cte('eval_runs')} SELECT fixture, CAST(sum(input_chars) AS BIGINT) AS input_chars,
  round((sum(input_chars) / 4 * 3 + sum(output_chars) / 4 * 15) / 1000000, 6) AS usd FROM eval_runs GROUP BY 1""")
def eval_cost(spark, sf):
    sums = bound(spark, sf, "eval_runs").groupBy("fixture").agg(F.sum("input_chars").alias("input_chars"), F.sum("output_chars").alias("o"))
    return sums.select("fixture", "input_chars", F.round(evl.cost_usd(F.col("input_chars"), F.col("o")), 6).alias("usd"))


@query("eval_missing_runs", f"WITH {cte('eval_runs')} SELECT fixture, run FROM eval_runs WHERE run NOT IN (SELECT run FROM eval_runs WHERE failed = 0)")
def eval_missing_runs(spark, sf):
    """Failed runs count as not recorded and are planned again."""
    runs = bound(spark, sf, "eval_runs").select("fixture", "run", "failed")
    return missing_runs(runs, runs.where("failed = 0"), "fixture", "run").select("fixture", "run")
