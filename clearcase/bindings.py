"""Domain tables derived from the generic driver tables.

Each binding is one SELECT in the SQL that Spark and DuckDB share, so an oracle
can state the same input without depending on the operator under test.  A
deployment replaces these with its own tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clearcase import fixed_values as fv

NL = "chr(10)"


def pick(values: list[str], index: str) -> str:
    """SQL choosing values[index % n] from a literal list (values hold no '|' or quote)."""
    return f"split_part('{'|'.join(values)}', '|', CAST(({index}) % {len(values)} AS INT) + 1)"


def digits(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {width}, '0')"


CPT_CHOICES = fv.KNOWN_CPT_CODES + ["27447", "27130", "29827", "99999", "2744"]
PAYER_CHOICES = [
    "Aetna", "Aetna PPO", "United Healthcare", "UHC", "UnitedHealthcare Choice", "Cigna", "cigna evicore ",
    "Blue Cross Blue Shield", "Anthem / Empire BCBS", "EMPIRE BCBS HMO", "Carelon", "Humana", "Medicare",
    "Evicore by Cigna", "  aetna  ", "Kaiser",
]
FIRST_NAMES = ["Marcus", "Rachel", "Sandra", "Rose", "Siobhan", "Grant", "Denise"]
LAST_NAMES = ["Webb", "Kimball", "Vance", "Okafor", "Lindqvist", "Delgado", "Marsh", "Tanaka", "Ferro", "Quill", "Abara"]
CITIES = ["Brooklyn", "Hoboken", "Tulsa", "Denver", "Yonkers"]
STATES = ["NY", "NJ", "OK", "CO", "NY"]

BINDINGS: dict[str, str] = {}

BINDINGS["organizations"] = """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_nationkey * 3 % 7 AS BIGINT) AS last_acknowledged_surgeon_count
FROM nation"""

BINDINGS["surgeons"] = f"""
SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS org_id, s_name AS full_name,
       {digits('s_suppkey', 10)} AS npi, s_acctbal >= 0 AS active
FROM supplier"""

BINDINGS["pa_cases"] = f"""
SELECT l_orderkey * 10 + l_linenumber AS id, CAST(s_nationkey AS BIGINT) AS org_id, l_suppkey AS surgeon_id,
       o_custkey AS created_by_user_id, {pick(CPT_CHOICES, 'l_partkey')} AS cpt_code,
       {pick(PAYER_CHOICES, 'l_orderkey')} AS payer, l_shipdate AS created_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey"""

BINDINGS["memberships"] = """
SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS org_id, c_custkey AS user_id,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'owner'
            WHEN c_mktsegment = 'HOUSEHOLD' THEN 'coordinator' ELSE 'front_desk' END AS role
FROM customer WHERE c_custkey % 5 <> 0"""

BINDINGS["users"] = """
SELECT c_custkey AS user_id, 'user' || CAST(c_custkey AS STRING) || '@clinic' || CAST(c_nationkey AS STRING) || '.example' AS email
FROM customer"""

BINDINGS["invitations"] = """
SELECT o_orderkey AS id, CAST(o_orderkey % 25 AS BIGINT) AS org_id,
       'user' || CAST(c_custkey AS STRING) || '@clinic' || CAST(c_nationkey AS STRING) || '.example' AS email,
       CASE WHEN o_orderkey % 2 = 0 THEN 'coordinator' ELSE 'front_desk' END AS role,
       CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS accepted_at, o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey"""

BINDINGS["waitlist"] = """
SELECT c_custkey AS id, 'Lead' || CAST(c_custkey % 1400 AS STRING) || '@Mail' || CAST(c_nationkey AS STRING) || '.Example ' AS raw_email,
       CASE WHEN c_custkey % 13 = 0 THEN 'bot' ELSE '' END AS honey,
       CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE c_name END AS practice_name,
       CAST(c_custkey % 4 AS BIGINT) AS email_stage,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal < 0 END AS unsubscribed,
       CAST(floor(c_custkey / 3) AS BIGINT) AS created_s
FROM customer"""

BINDINGS["outcomes"] = f"""
SELECT o_orderkey AS id, o_orderdate AS ts,
       CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE ' ' || {pick(CPT_CHOICES, 'o_orderkey')} END AS cpt_code,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE {pick(PAYER_CHOICES, 'o_custkey')} END AS payer_name,
       CASE WHEN o_orderkey % 31 = 0 THEN 'maybe' WHEN o_orderstatus = 'F' THEN 'approved'
            WHEN o_orderstatus = 'P' THEN 'denied' ELSE 'pending' END AS outcome,
       CASE WHEN o_orderkey % 3 = 0 THEN ' Not medically necessary, ref ' || CAST(o_orderkey AS STRING) || ' '
            WHEN o_orderkey % 37 = 0 THEN repeat('x', 5001) WHEN o_orderkey % 5 = 0 THEN '  ' END AS denial_reason,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 5000) AS DOUBLE) / 10 END AS pa_score
FROM orders"""

BINDINGS["requests"] = """
SELECT event_id, CAST(floor(event_id / 3) * 1000 AS BIGINT) AS at_ms,
       CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 20 END AS key,
       CASE event_type WHEN 'purchase' THEN 'generation' WHEN 'signup' THEN 'regeneration'
            WHEN 'error' THEN 'admin' ELSE 'light' END AS class
FROM events"""

BINDINGS["product_events"] = f"""
SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN user_id % 3 ELSE user_id END AS user_id,
       CASE event_type WHEN 'view' THEN 'pa_generation_started' WHEN 'purchase' THEN 'pa_generation_succeeded'
            WHEN 'error' THEN 'pa_generation_failed' WHEN 'click' THEN 'pa_exported'
            ELSE 'deid_verification_failed' END AS event,
       '{{"payer":"' || {pick(PAYER_CHOICES, 'event_id')} || '","duration_ms":' || CAST(CAST(floor(value * 100) AS BIGINT) AS STRING)
         || ',"hard_block_count":' || CAST(event_id % 4 AS STRING) || ',"stage":"' || {pick(['intake', 'extraction', 'narrative'], 'event_id')}
         || '","leak_count":' || CAST(event_id % 6 AS STRING) || '}}' AS props
FROM events"""

# Chart text: one per customer, holding every labelled identifier the redactor knows.
_who = f"{pick(FIRST_NAMES, 'c_custkey')}"
_last = f"{pick(LAST_NAMES, 'c_custkey')}"
_name_line = f"""CASE c_custkey % 4
  WHEN 0 THEN 'Patient: ' || {_who} || ' ' || {_last}
  WHEN 1 THEN 'Patient name: ' || {_last} || ', ' || {_who}
  WHEN 2 THEN 'Re: ' || {_who} || ' ' || {_last}
  ELSE upper({_last}) || ', ' || upper({_who}) END"""
BINDINGS["charts"] = f"""
SELECT c_custkey AS chart_id, CAST(c_nationkey AS BIGINT) AS org_id, 'chart' || CAST(c_custkey AS STRING) ||
       {pick(['.txt', '.pdf', '.docx', '.TXT', '.rtf'], 'c_custkey')} AS file_name,
       {_name_line} || {NL} ||
       'DOB: ' || {digits('1 + c_custkey % 12', 2)} || '/' || {digits('1 + c_custkey % 28', 2)} || '/' || CAST(1930 + c_custkey % 60 AS STRING)
       || '  MRN: ' || 'A' || {digits('c_custkey * 7', 7)} || {NL} ||
       'SSN ' || {digits('100 + c_custkey % 800', 3)} || '-' || {digits('10 + c_custkey % 89', 2)} || '-' || {digits('c_custkey', 4)}
       || CASE WHEN c_custkey % 3 = 0 THEN ' and 123-45-' || {digits('c_custkey % 9999', 4)} ELSE '' END || '.' || {NL} ||
       'Phone: 212-555-' || {digits('c_custkey % 10000', 4)} || '. Fax: (718) 555-' || {digits('c_custkey * 3 % 10000', 4)}
       || '. Cell: 646555' || {digits('c_custkey % 10000', 4)} || '.' || {NL} ||
       'Email: pt' || CAST(c_custkey AS STRING) || '@mail.example.com. Portal https://portal.example.com/p/' || CAST(c_custkey AS STRING)
       || ' from 10.0.' || CAST(c_custkey % 256 AS STRING) || '.' || CAST(c_custkey * 7 % 256 AS STRING) || ' ok.' || {NL} ||
       'Member ID: W' || {digits('c_custkey', 8)} || '. Office NPI: 1' || {digits('c_custkey', 9)} || '. DEA: AB' || {digits('c_custkey', 7)} || '.' || {NL} ||
       'Address: ' || CAST(1 + c_custkey % 900 AS STRING) || ' Maple Grove ' || {pick(['Street', 'Ave', 'Road', 'Lane'], 'c_custkey')} || {NL} ||
       'Lives in ' || {pick(CITIES, 'c_custkey')} || ', ' || {pick(STATES, 'c_custkey')} || ' ' || {digits('10000 + c_custkey % 80000', 5)} || '. P.O. Box ' || CAST(10 + c_custkey AS STRING) || '.' || {NL} ||
       'This ' || CAST(20 + c_custkey % 79 AS STRING) || '-year-old patient was seen on ' || CAST(1 + c_custkey % 12 AS STRING) || '/' || CAST(1 + c_custkey % 28 AS STRING)
       || ' and on ' || {pick(['January 15th, 2024', 'June 2024', '6/2024', '2024-03-0' + '4', 'late 2023', '15 Jan 2024', 'May of 2024'], 'c_custkey')} || '. Strength 4/5. Pain 7/10.' || {NL} ||
       'Seen at Northside Orthopedic Clinic. ' || {pick(['Sarah Chen, MD', 'Luis Ortega, DO', 'Amy Park, PA-C'], 'c_custkey')} || ' advised surgery; Dr. '
       || {pick(['Chen', 'Ortega', 'Park'], 'c_custkey')} || ' agreed.' || {NL} ||
       'Emergency contact: Denise ' || {_last} || {NL} ||
       'Insurance: ' || trim({pick(PAYER_CHOICES, 'c_custkey')}) || '. CPT ' || {pick(CPT_CHOICES, 'c_custkey')} || '. ICD M17.11. Her file is XJ' || CAST(c_custkey % 10 AS STRING) || '-889-21 here.' || {NL} ||
       'Mr. ' || {_last} || ' reports ' || CAST(2 + c_custkey % 30 AS STRING) || ' weeks of pain. MRI ' || {pick(['is pending', 'was completed', 'scheduled'], 'c_custkey')} || '.' || {NL} ||
       CASE WHEN c_custkey % 6 = 0 THEN 'Reference value 2125551234 noted by Tamsin Holloway.' ELSE 'Ambulates with a cane.' END AS text
FROM customer"""

# Model extractions as raw JSON text, one per order; some fenced, some broken.
_treatments = """CASE o_orderkey % 7
  WHEN 0 THEN '[]'
  WHEN 1 THEN '[{"treatment":"Physical therapy","duration":"' || CAST(2 + o_orderkey % 30 AS STRING) || ' weeks","outcome":"minimal relief","dates":"06/2024"},{"name":"NSAIDs","duration":"3 months","dates":"June 2024"}]'
  WHEN 2 THEN '[{"treatment_name":" Physical therapy ","duration":null,"outcome":" "},{"treatment":"Corticosteroid injection","duration":"2 weeks","relief_duration":"2 weeks","dates":"March 3, 2024"}]'
  WHEN 3 THEN '[{"treatment":"No NSAIDs prescribed","duration":"6 weeks"},{"treatment":"PT program","duration":"' || CAST(1 + o_orderkey % 9 AS STRING) || ' months"},{"treatment":"Activity modification","duration":"3+ years"}]'
  WHEN 4 THEN '[{"treatment":"Provider-directed non-surgical management","duration":"' || CAST(1 + o_orderkey % 5 AS STRING) || ' months"},{"treatment":"acetaminophen","duration":"10 sessions"},{"outcome":"none"}]'
  WHEN 5 THEN '[{"treatment":"NSAIDs"},{"treatment":"nsaids ","duration":"12 weeks"},{"treatment":"Physical therapy and denied bracing","duration":"24 weeks"}]'
  ELSE '[{"treatment":"Conservative management","duration":"14 weeks","dates":"2024-01-05"},{"treatment":"Physical therapy","duration":"8 weeks","dates":"01/05/2024"}]' END"""
_imaging = """CASE o_orderkey % 6
  WHEN 0 THEN 'null'
  WHEN 1 THEN '{"xray":{"completed":true,"date":"01/05/2024","findings":"KL grade 3"},"mri":{"completed":false}}'
  WHEN 2 THEN '{"xray":{"completed":true,"findings":" joint space narrowing "},"mri":{"completed":true,"date":"June 2024","findings":"full-thickness tear"}}'
  WHEN 3 THEN '{"modality":"MRI shoulder","key_findings":"tear"}'
  WHEN 4 THEN '{"modality":"X-ray","findings":" "}'
  ELSE '{"xray":{"completed":false},"mri":{"completed":true,"findings":""}}' END"""
_flags = """CASE o_orderkey % 5
  WHEN 0 THEN '[]'
  WHEN 1 THEN '[{"id":"","label":" Imaging gap ","severity":"high","explanation":"No MRI","anchorText":"MRI"}]'
  WHEN 2 THEN '[{"id":"f-9","severity":"urgent","explanation":" short course ","recommendation":"Add dates"}]'
  ELSE '[{"label":"Payer requirement not confirmed: MRI shoulder","severity":"low"},{"id":"payer-hardreq-3","label":"old"}]' END"""
_json = f"""'{{"patient_name":' || CASE WHEN o_orderkey % 11 = 0 THEN 'null' WHEN o_orderkey % 11 = 1 THEN '"  "'
       ELSE '" ' || {pick(FIRST_NAMES, 'o_orderkey')} || ' ' || {pick(LAST_NAMES, 'o_orderkey')} || ' "' END
  || ',"date_of_birth":"' || {digits('1 + o_orderkey % 12', 2)} || '/' || {digits('1 + o_orderkey % 28', 2)} || '/1961"'
  || ',"diagnosis_codes":' || {pick(['[]', '["M17.11"]', '["M17.11","M17.12"]', '["M75.121"," ",""]'], 'o_orderkey')}
  || ',"primary_complaint":"' || {pick(['knee pain', 'shoulder pain', 'hip pain'], 'o_orderkey')} || '"'
  || ',"symptom_duration":' || {pick(['null', '"3 months"', '"2-year history"', '"10 weeks"', '"3+ years"', '"90 days"', '"several years"', '"11.9 weeks"', '"1 year"'], 'o_orderkey')}
  || ',"functional_limitations":' || {pick(['[]', '["cannot climb stairs"]', '["unable to walk more than one block","difficulty with overhead lifting"]', '[" ","cannot sleep on right side","limited reaching"]'], 'CAST(floor(o_orderkey / 4) AS BIGINT)')}
  || ',"objective_measurements":["ROM 120"]'
  || ',"conservative_treatments_attempted":' || {_treatments}
  || ',"imaging_findings":' || {_imaging}
  || ',"imaging_status":"' || {pick(['completed', 'pending', 'done', 'not_ordered', 'completed'], 'o_orderkey')} || '"'
  || ',"requested_procedure":' || CASE WHEN o_orderkey % 13 = 0 THEN 'null' ELSE '" Total knee arthroplasty "' END
  || ',"surgical_approach_if_mentioned":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"cemented, medial parapatellar"' END
  || ',"pain_score":"' || CAST(o_orderkey % 10 AS STRING) || '/10"'
  || ',"bmi":' || {pick(['null', '31', '"28.4 kg/m2"', '"unknown"', '41.5', '36', '24'], 'o_orderkey')}
  || ',"asa_classification":' || {pick(['null', '" II "', '3', '""'], 'o_orderkey')}
  || ',"denial_risk_flags":' || {_flags}
  || ',"pa_strength":' || CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE '{{"diagnosis_codes":{{"score":' || CAST(o_orderkey % 3 AS STRING)
       || ',"note":" specific codes "}},"surgical_approach":{{"score":' || CAST(o_orderkey % 2 AS STRING) || ',"note":"n","anchorText":" APPROACH "}}}}' END
  || '}}'"""
BINDINGS["raw_extractions"] = f"""
SELECT o_orderkey AS case_id, CAST(o_custkey AS BIGINT) AS chart_id, {pick(CPT_CHOICES, 'o_orderkey')} AS cpt_code,
       {pick(PAYER_CHOICES, 'CAST(floor(o_orderkey / 3) AS BIGINT)')} AS payer_name,
       {pick(['Dr. Sarah Chen', 'Luis Ortega DO', 'Amy Park'], 'o_orderkey')} AS provider_name,
       CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'Northside Orthopedics' END AS practice_name,
       CASE WHEN o_orderkey % 19 = 0 THEN '```json' || {NL} || {_json} || {NL} || '```'
            WHEN o_orderkey % 53 = 0 THEN 'Sorry, no record'
            WHEN o_orderkey % 17 = 0 THEN 'Here it is: ' || {_json} || ' done' ELSE {_json} END AS raw_json
FROM orders"""

# Letters drafted by a model: two attempts per order, some refused, some duplicated.
_letter = f"""'Letter of Medical Necessity' || {NL} || '[DATE]' || {NL} || {NL} ||
  CASE WHEN o_orderkey % 5 = 0 THEN {pick(PAYER_CHOICES, 'CAST(floor(o_orderkey / 3) AS BIGINT)')} || {NL} ELSE '' END ||
  '[ADDRESS]' || {NL} || '[City, State, ZIP]' || {NL} || {NL} || 'Re: [Patient Name], CPT [CPT Code]' || {NL} || '[Unknown Field]' || {NL} || {NL} ||
  'CLINICAL HISTORY AND PRESENTING COMPLAINT' || {NL} || 'The patient has had ' || {pick(['3 months', '14 weeks', '9 weeks'], 'o_orderkey')} || ' of pain since ' ||
  {pick(['June 2024', '06/2024', 'January 5, 2024', 'late 2022'], 'o_orderkey')} || '. The patient is unable to climb stairs without help. Duration is not documented. ' || {NL} || {NL} ||
  'FUNCTIONAL LIMITATIONS' || {NL} || 'The patient has difficulty with overhead lifting. The patient cannot dance at weddings.' || {NL} || {NL} ||
  'CONSERVATIVE TREATMENT HISTORY' || {NL} || 'Naproxen ' || CAST(250 * (1 + o_orderkey % 3) AS STRING) || ' mg was taken; physical therapy for 8 weeks.' || {NL} || {NL} ||
  'REQUESTED PROCEDURE' || {NL} || CASE WHEN o_orderkey % 2 = 0 THEN 'A cemented implant with allograft is planned.' ELSE 'Total knee arthroplasty.' END
  || CASE WHEN o_orderkey % 6 = 0 THEN ' Imaging: [REQUIRES PHYSICIAN REVIEW — IMAGING PENDING]' ELSE '' END || {NL} || {NL} ||
  'MEDICAL NECESSITY SUMMARY' || {NL} || 'Activities of daily living are difficult to perform. The plan will follow up with MRI.' || {NL} || {NL} || 'Sincerely,' || {NL} || 'Sarah Chen, MD' ||
  CASE WHEN o_orderkey % 9 = 0 THEN {NL} || 'Northside Orthopedics' || {NL} || {NL} || 'Re: second draft' || {NL} || 'Sincerely,' || {NL} || 'Sarah Chen, MD' ELSE '' END"""
BINDINGS["drafts"] = f"""
SELECT o_orderkey AS case_id, CAST(a.attempt AS BIGINT) AS attempt, 'November 3, 2025' AS letter_date,
       CASE WHEN o_orderkey % 21 = 0 THEN 'Cannot generate authorization letter: imaging missing.'
            WHEN a.attempt = 2 AND o_orderkey % 2 = 0 THEN 'Dear reviewer,' || {NL} || 'Naproxen 500 mg was taken. The knee hurts.' || {NL} || 'Sincerely,' || {NL} || 'Sarah Chen, MD'
            ELSE {_letter} END AS text
FROM (SELECT *, 1 AS attempt FROM orders UNION ALL SELECT *, 2 AS attempt FROM orders ) a"""

BINDINGS["supplements"] = f"""
SELECT o_orderkey AS case_id, {pick(['symptom_duration', 'surgical_approach', 'diagnosis_codes', 'functional_limitations', 'imaging_findings', 'conservative_treatments_named', 'conservative_treatment_duration', 'cpt_code_valid'], 'o_orderkey + s.k')} AS key,
       CASE {pick(['symptom_duration', 'surgical_approach', 'diagnosis_codes', 'functional_limitations', 'imaging_findings', 'conservative_treatments_named', 'conservative_treatment_duration', 'cpt_code_valid'], 'o_orderkey + s.k')}
         WHEN 'symptom_duration' THEN CASE WHEN s.k = 8 THEN '10 weeks' ELSE ' 8 months ' END WHEN 'surgical_approach' THEN 'posterior approach' WHEN 'diagnosis_codes' THEN 'm17.11'
         WHEN 'functional_limitations' THEN 'Cannot climb stairs' WHEN 'imaging_findings' THEN 'KL grade 4 on repeat film'
         WHEN 'conservative_treatments_named' THEN 'Aquatic therapy' WHEN 'conservative_treatment_duration' THEN '16 weeks'
         ELSE 'use 29827 or 99999' END AS value, s.k AS seq
FROM (SELECT *, 0 AS k FROM orders UNION ALL SELECT *, 3 AS k FROM orders UNION ALL SELECT *, 5 AS k FROM orders UNION ALL SELECT *, 8 AS k FROM orders ) s"""

# Repeated evaluation runs: one per lineitem; run order by line number.
BINDINGS["eval_runs"] = f"""
SELECT l_orderkey AS case_id, 'fixture' || CAST(l_orderkey % 200 AS STRING) AS fixture,
       {pick(['generate', 'regenerate', 'fix'], 'l_partkey')} AS route,
       l_orderkey * 10 + l_linenumber AS run, CAST(l_suppkey % 9 = 0 AS INT) AS failed,
       CAST(floor(l_extendedprice) AS BIGINT) AS input_chars, CAST(floor(l_quantity * 100) AS BIGINT) AS output_chars
FROM lineitem"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


# Tables whose rows get much work each (parsing, many regular expressions), and the key their source rows are dealt by.
HEAVY = {"documents": None, "pages": None, "conversations": None, "charts": "c_custkey", "raw_extractions": "o_orderkey", "drafts": "o_orderkey"}
#: Rows of a heavy table in one task.
TASK_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows over all cores, and over as many tasks as they need, so that no task grows with the table.

    The splits of a scan follow bytes, of which a row that becomes a long text may have few. With a ``key``, the narrow
    source rows are dealt by it, so that texts made of them are joined by that key where they are; else a table of enough
    splits is left as it is.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    if key is not None:
        return df.repartition(tasks, key)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The domain table ``name`` over the driver tables in ``sf_dir``."""
    text = BINDINGS[name]
    sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in text.replace("\n", " ")}
    if name in HEAVY:
        sources = {t: spread(df, HEAVY[name]) for t, df in sources.items()}
    return spark.sql(_as_parameters(text, sources), **sources)


def _as_parameters(text: str, sources: dict[str, DataFrame]) -> str:
    """Turn table names in FROM and JOIN into ``spark.sql`` DataFrame parameters."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in sources:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {name} ", f"{word} {{{name}}} ").replace(f"{word} {name}\n", f"{word} {{{name}}}\n")
            if text.endswith(f"{word} {name}"):
                text = text[: -len(name)] + f"{{{name}}}"
    return text


def cte(*names: str) -> str:
    """A WITH list of bindings for an oracle (no WITH keyword, no trailing comma)."""
    return ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in names)
