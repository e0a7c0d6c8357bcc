"""DuckDB statements of normalized and scored cases, shared by several oracles."""

from __future__ import annotations

from clearcase import fixed_values as fv
from clearcase.bindings import cte
from clearcase.operators import rules as rl


def keyed_hash(v: str, key: str) -> str:
    """HMAC-SHA256 of the trimmed lower-case text, put together of SHA-256 of bytes (keys up to 64 bytes)."""
    pad = lambda x: "".join(f"\\x{b ^ x:02X}" for b in key.encode().ljust(64, b"\0"))
    return f"sha256('{pad(0x5C)}'::BLOB || unhex(sha256('{pad(0x36)}'::BLOB || encode(lower(trim({v}))))))"


def text(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'VARCHAR' THEN nullif(trim({v} ->> '$'), '') END"


def raw(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'VARCHAR' THEN {v} ->> '$' END"


def items(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'ARRAY' THEN CAST({v} AS JSON[]) ELSE [] END"


def first_of(v: str, *keys: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN json_type({v} -> '$.{k}') <> 'NULL' THEN {v} -> '$.{k}' END" for k in keys) + ")"


def strings(v: str) -> str:
    return f"list_transform(list_filter({items(v)}, lambda x: ({text('x')}) IS NOT NULL), lambda x: x ->> '$')"


_obj = "json_type(x) = 'OBJECT'"
TREATMENTS = f"""list_transform({items("r -> '$.conservative_treatments_attempted'")}, lambda x: {{
  'treatment': coalesce(CASE WHEN {_obj} THEN {text("(" + first_of('x', 'treatment_name', 'treatment', 'name') + ")")} ELSE {text('x')} END, 'Unknown Treatment'),
  'duration': coalesce(CASE WHEN {_obj} THEN {text("(x -> '$.duration')")} END, 'Unknown'),
  'outcome': coalesce(CASE WHEN {_obj} THEN {text("(x -> '$.outcome')")} END, 'Failed'),
  'dates': coalesce(CASE WHEN {_obj} THEN {text("(x -> '$.dates')")} END, 'Not documented'),
  'relief_duration': CASE WHEN {_obj} THEN {text("(x -> '$.relief_duration')")} END }})"""


def _done(k):
    return f"coalesce(json_type(i -> '$.{k}') = 'OBJECT' AND (i ->> '$.{k}.completed') = 'true', false)"


def _finding(k, label):
    said = text(f"(i -> '$.{k}.findings')")
    day = text(f"(i -> '$.{k}.date')")
    return f"CASE WHEN {_done(k)} THEN '{label}' || coalesce(' (' || ({day}) || ')', '') || ': ' || ({said}) END"


_studies = "(coalesce(json_type(i -> '$.xray') = 'OBJECT', false) OR coalesce(json_type(i -> '$.mri') = 'OBJECT', false))"
MODALITY = f"""CASE WHEN json_type(i) = 'OBJECT' THEN CASE WHEN {_studies} THEN nullif(concat_ws(' and ', CASE WHEN {_done('xray')} THEN 'X-ray' END, CASE WHEN {_done('mri')} THEN 'MRI' END), '')
  ELSE {text("(i -> '$.modality')")} END END"""
FINDINGS = f"""CASE WHEN json_type(i) = 'OBJECT' THEN CASE WHEN {_studies} THEN nullif(concat_ws('; ', {_finding('xray', 'X-ray')}, {_finding('mri', 'MRI')}), '')
  ELSE {text("(" + first_of('i', 'key_findings', 'findings') + ")")} END END"""
FLAGS = f"""list_transform({items("r -> '$.denial_risk_flags'")}, lambda x, n: {{
  'id': coalesce(nullif({raw("(x -> '$.id')")}, ''), 'flag-' || CAST(n AS VARCHAR)), 'label': coalesce(trim({raw("(x -> '$.label')")}), 'Documentation Gap'),
  'severity': CASE WHEN (x ->> '$.severity') IN ('high', 'medium', 'low') THEN x ->> '$.severity' ELSE 'medium' END,
  'explanation': coalesce(trim({raw("(x -> '$.explanation')")}), ''), 'recommendation': coalesce(trim({raw("(x -> '$.recommendation')")}), ''),
  'anchor': coalesce(trim({raw("(x -> '$.anchorText')")}), '') }})"""


def _judged(k):
    return f"""CASE WHEN json_type(r -> '$.pa_strength') = 'OBJECT' THEN CASE WHEN (r ->> '$.pa_strength.{k}.score') = '1' THEN 1 ELSE 0 END END"""


PARSED = f"""
{cte('raw_extractions')},
c0 AS (SELECT *, trim(regexp_replace(regexp_replace(raw_json, '(?i)^```(?:json)?\\s*', ''), '\\s*```\\s*$', ''), chr(10) || ' ') AS t FROM raw_extractions),
c1 AS (SELECT *, CASE WHEN regexp_matches(t, '(?s)\\{{.*\\}}') THEN regexp_extract(t, '(?s)\\{{.*\\}}') ELSE t END AS j FROM c0),
c2 AS (SELECT *, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS r FROM c1)"""

NORM = f"""{PARSED},
n0 AS (SELECT *, r -> '$.imaging_findings' AS i FROM c2 WHERE r IS NOT NULL),
norm AS (SELECT case_id, chart_id, cpt_code, payer_name, provider_name, practice_name,
  {text("(r -> '$.patient_name')")} AS patient_name, {text("(r -> '$.date_of_birth')")} AS date_of_birth,
  {strings("(r -> '$.diagnosis_codes')")} AS diagnosis_codes, {text("(r -> '$.primary_complaint')")} AS primary_complaint,
  {text("(r -> '$.symptom_duration')")} AS symptom_duration,
  {strings("(r -> '$.functional_limitations')")} AS functional_limitations, {strings("(r -> '$.objective_measurements')")} AS objective_measurements,
  {TREATMENTS} AS treatments, {MODALITY} AS modality, {FINDINGS} AS findings,
  CASE WHEN (r ->> '$.imaging_status') IN ('pending', 'not_ordered', 'completed') THEN r ->> '$.imaging_status' ELSE 'not_ordered' END AS imaging_status,
  {text("(r -> '$.requested_procedure')")} AS requested_procedure, {text("(r -> '$.surgical_approach_if_mentioned')")} AS surgical_approach,
  {text("(r -> '$.pain_score')")} AS pain_score,
  CASE WHEN json_type(r -> '$.bmi') = 'VARCHAR' THEN TRY_CAST(nullif(regexp_extract(r ->> '$.bmi', '\\d+(?:\\.\\d+)?'), '') AS DOUBLE)
       WHEN json_type(r -> '$.bmi') <> 'NULL' THEN TRY_CAST(r ->> '$.bmi' AS DOUBLE) END AS bmi,
  nullif(trim(CASE WHEN json_type(r -> '$.asa_classification') <> 'NULL' THEN r ->> '$.asa_classification' END), '') AS asa_classification,
  {FLAGS} AS risk_flags, {_judged('diagnosis_codes')} AS judged_diagnosis, {_judged('surgical_approach')} AS judged_approach
  FROM n0)"""


def weeks(v: str) -> str:
    """Payer weeks of a duration text."""
    p = "'(?i)(\\d+(?:\\.\\d+)?)\\s*(week|month)'"
    return (f"coalesce(CAST(floor(TRY_CAST(nullif(regexp_extract({v}, {p}, 1), '') AS DOUBLE) * "
            f"CASE WHEN lower(regexp_extract({v}, {p}, 2)) = 'month' THEN 4.33::DOUBLE ELSE 1 END + 0.5) AS BIGINT), 0)")


def symptom_weeks(v: str) -> str:
    p = "'(?i)(\\d+(?:\\.\\d+)?)\\+?\\s*(day|week|month|year)'"
    n = f"TRY_CAST(nullif(regexp_extract({v}, {p}, 1), '') AS DOUBLE)"
    return (f"CASE lower(regexp_extract({v}, {p}, 2)) WHEN 'day' THEN {n} / 7 WHEN 'week' THEN {n} "
            f"WHEN 'month' THEN {n} * 4.33::DOUBLE WHEN 'year' THEN {n} * 52 END")


def has_duration(v: str) -> str:
    return f"regexp_matches({v}, '(?i)\\d+(?:\\.\\d+)?\\+?\\s*(day|week|month|year|session|visit)s?\\b')"


KNOWN = ", ".join(f"'{c}'" for c in fv.KNOWN_CPT_CODES)
SCORED = f"""{NORM},
s0 AS (SELECT *,
  len(list_distinct(list_filter(list_transform(treatments, lambda t: lower(trim(t.treatment))),
      lambda x: x NOT IN ('', 'unknown treatment', 'conservative treatment history not documented')))) AS named,
  list_filter(treatments, lambda t: NOT regexp_matches(t.treatment, '(?i)injection')) AS course FROM norm),
s1 AS (SELECT *, len(course) AS dn, len(list_filter(course, lambda t: {has_duration('t.duration')})) AS dd FROM s0),
scored AS (SELECT *,
  coalesce(judged_diagnosis, CAST(len(diagnosis_codes) > 0 AS INT)) AS f_dx, CAST(named >= 2 AS INT) AS f_named,
  CASE WHEN dn >= 2 AND floor(dd / dn * 100 + 0.5) >= 50 THEN 1 ELSE 0 END AS f_dur0,
  CAST(coalesce(findings, '') <> '' AS INT) AS f_img, CAST(len(functional_limitations) >= 2 AS INT) AS f_lim,
  coalesce(judged_approach, CAST(surgical_approach IS NOT NULL AS INT)) AS f_app,
  CASE WHEN trim(cpt_code) IN ({KNOWN}) THEN 1 ELSE 0 END AS f_cpt,
  CASE WHEN ({symptom_weeks('symptom_duration')}) >= 12 THEN 1 ELSE 0 END AS f_sym FROM s1)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rule_rows() -> str:
    rows = []
    for r in rl.default_rules():
        needs = ", ".join(f"{{'treatment': {_q(t)}, 'minimum_duration': {_q(d)}}}" for t, d, _ in r[7])
        studies = ", ".join(f"{{'modality': {_q(m)}, 'required': {str(q).lower()}}}" for m, q, _ in r[8])
        soft = [", ".join(_q(x) for x in r[k]) for k in (9, 10, 11)]
        rows.append(f"({_q(r[0])}, {_q(r[1])}, {_q(r[2])}, {_q(r[4])}, [{needs}], [{studies}], [{soft[0]}], [{soft[1]}], [{soft[2]}])")
    return ",\n".join(rows)


_aliases = sorted(dict(fv.PAYER_ALIASES).items(), key=lambda a: -len(a[0]))
ALIAS_VALUES = ", ".join(f"({_q(a)}, {_q(i)}, {n})" for n, (a, i) in enumerate(_aliases))
RULES = f"""rules AS (SELECT * FROM (VALUES {_rule_rows()}) v(payer_id, rule_payer_name, rule_cpt, status, needs, studies, functional, radiographic, documents)),
alias AS (SELECT * FROM (VALUES {ALIAS_VALUES}) v(a, id, rank)),
payers AS (SELECT DISTINCT payer_name AS p FROM raw_extractions),
payer AS (SELECT p, coalesce((SELECT min(id) FROM alias WHERE a = lower(trim(p))),
                             (SELECT arg_min(id, rank) FROM alias WHERE contains(lower(trim(p)), a))) AS case_payer_id FROM payers)"""


def phrases(label: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array(trim(regexp_replace({label}, '\\([^)]*\\)', '', 'g')), '(?i)\\s+or\\s+|/'), "
            "lambda p: lower(trim(p))), lambda p: len(p) >= 3)")


_neg = ", ".join(f"'{w}'" for w in fv.NEGATION_WORDS)


def _matches(label: str) -> str:
    before = "trim(substr(lower(t.treatment), 1, instr(lower(t.treatment), p) - 1))"
    words = f"string_split_regex({before}, '\\s+')[-4:]"
    clean = f"len(list_filter({words}, lambda w: regexp_replace(w, '[^a-z]', '', 'g') IN ({_neg}))) = 0"
    return (f"list_filter(treatments, lambda t: len(list_filter({phrases(label)}, "
            f"lambda p: instr(lower(t.treatment), p) > 0 AND {clean})) > 0)")


_valid = "status = 'validated'"
RULED = f"""{SCORED}, {RULES},
ruled AS (SELECT s.*, payer.case_payer_id, rules.* EXCLUDE (payer_id),
    coalesce(list_max(list_transform(list_filter(treatments, lambda t: contains(lower(t.treatment), 'physical therapy') OR regexp_matches(lower(t.treatment), '\\bpt\\b')),
             lambda t: {weeks('t.duration')})), 0) AS have,
    coalesce({weeks("list_filter(needs, lambda q: contains(lower(q.treatment), 'physical therapy'))[1].minimum_duration")}, 0) AS need
  FROM scored s JOIN payer ON payer.p = s.payer_name LEFT JOIN rules ON rules.payer_id = payer.case_payer_id AND rules.rule_cpt = s.cpt_code),
final AS (SELECT *, coalesce({_valid}, false) AND need > 0 AND have > 0 AND have < need AS penalized,
    CASE WHEN coalesce({_valid}, false) AND need > 0 AND have > 0 AND have < need THEN 0 ELSE f_dur0 END AS f_dur FROM ruled),
earned AS (SELECT *, f_dx * 10 + f_named * 20 + f_dur * 10 + f_img * 15 + f_lim * 15 + f_app * 10 + f_cpt * 10 + f_sym * 10 AS points FROM final),
needed AS (SELECT case_id, k - 1 AS pos, treatments, status, needs[k].treatment AS label, needs[k].minimum_duration AS requirement FROM earned CROSS JOIN range(1, 9) g(k) WHERE k <= len(needs)),
checked AS (
  SELECT case_id, pos, label, requirement, true AS hard,
    CASE WHEN status <> 'validated' OR {weeks('requirement')} = 0 OR w = 0 THEN 'unverifiable' WHEN w >= {weeks('requirement')} THEN 'met' ELSE 'not_met' END AS verdict
  FROM (SELECT *, coalesce(list_max(list_transform({_matches('label')}, lambda t: {weeks('t.duration')})), 0) AS w FROM needed)
  UNION ALL SELECT case_id, len(needs) + k - 1, studies[k].modality, CASE WHEN studies[k].required THEN 'Required' ELSE 'Optional' END, studies[k].required,
    CASE WHEN status <> 'validated' THEN 'unverifiable'
         WHEN contains(lower(coalesce(modality, '')), lower(trim(split_part(studies[k].modality, '(', 1)))) AND imaging_status = 'completed' THEN 'met' ELSE 'not_met' END
    FROM earned CROSS JOIN range(1, 9) g(k) WHERE k <= len(studies)
  UNION ALL SELECT case_id, len(needs) + len(studies) + k - 1, functional[k], 'Functional criterion — address in letter', false, 'unverifiable' FROM earned CROSS JOIN range(1, 9) g(k) WHERE k <= len(functional)
  UNION ALL SELECT case_id, len(needs) + len(studies) + len(functional) + k - 1, radiographic[k], 'Radiographic criterion', false, 'unverifiable' FROM earned CROSS JOIN range(1, 9) g(k) WHERE k <= len(radiographic)
  UNION ALL SELECT case_id, len(needs) + len(studies) + len(functional) + len(radiographic) + k - 1, documents[k], 'Supporting documentation', false, 'unverifiable' FROM earned CROSS JOIN range(1, 9) g(k) WHERE k <= len(documents))"""
