"""Queries over vocabularies, typed leaves, sketches and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clearcase.bindings import bound, cte, table
from clearcase.functions import text as tx
from clearcase.operators import deid
from clearcase.operators import events as ev
from clearcase.operators import vocabulary as vo
from clearcase.plans import case_oracle as o
from clearcase.plans.case_queries import records
from clearcase.plans.registry import query
from clearcase.session import checkpoint_dir
from clearcase.sources import keyed, ledger

_CHAIN = r"\b[A-Z][a-z]+(?:[ \t][A-Z][a-z]+)*\b"


@query("document_unknown_phrases", rf"""
WITH v AS (SELECT DISTINCT w FROM (
  SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark
  UNION ALL SELECT regexp_replace(lower(unnest(regexp_extract_all(text, '{_CHAIN}'))), '\s+', ' ', 'g') FROM benchmark) WHERE w <> ''),
h AS (SELECT doc_id, regexp_extract_all(text, '{_CHAIN}') AS h FROM documents),
s AS (SELECT doc_id, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS raw FROM h),
r AS (SELECT DISTINCT raw FROM s),
w AS (SELECT raw, len(string_split_regex(lower(raw), '[ \t]+')) AS n, unnest(string_split_regex(lower(raw), '[ \t]+')) AS word FROM r),
k AS (SELECT raw FROM w LEFT JOIN v ON v.w = w.word GROUP BY raw HAVING any_value(n) > 1 AND count(v.w) = count(*)
      UNION SELECT raw FROM r JOIN v ON v.w = regexp_replace(lower(raw), '\s+', ' ', 'g'))
SELECT doc_id, pos, raw FROM s WHERE raw NOT IN (SELECT raw FROM k)""")
def document_unknown_phrases(spark, sf):
    """Capitalized chains of the documents that a vocabulary of benchmark words and chains does not allow."""
    texts = table(spark, sf, "benchmark")
    chains = F.explode(F.regexp_extract_all("text", F.lit(deid.edges(_CHAIN)), F.lit(0))).alias("phrase")
    words = texts.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("phrase")).unionByName(texts.select(chains))
    hits = F.posexplode(F.regexp_extract_all("text", F.lit(deid.edges(_CHAIN)), F.lit(0))).alias("pos", "raw")
    spans = table(spark, sf, "documents").select("doc_id", hits).withColumn("pos", F.col("pos").cast("bigint"))
    return vo.unknown(spans, vo.table(words)).select("doc_id", "pos", "raw")


_LIST = "array_to_string(list_transform(treatments, lambda t: t.treatment || ':' || t.dates), '|')"


@query("record_leaf_round_trip", f"""WITH {o.NORM}
SELECT case_id, patient_name, date_of_birth, bmi, {_LIST} AS treatments, array_to_string(diagnosis_codes, '|') AS diagnosis_codes, modality,
  CAST(patient_name IS NOT NULL AS INT) + CAST(date_of_birth IS NOT NULL AS INT)
    + len(list_filter(treatments, lambda t: contains(t.treatment, 'Physical therapy'))) + len(list_filter(diagnosis_codes, lambda d: d = 'M17.11')) AS masked FROM norm""")
def record_leaf_round_trip(spark, sf):
    """Whole typed records with their values masked at every text leaf, and restored leaf by leaf."""
    entry = lambda token, raw: F.struct(F.lit(token).alias("cat"), F.lit(1).alias("n"), F.lit(f"[{token}]").alias("token"), raw.alias("raw"), F.lit(None).cast("string").alias("key"))
    values = {"PATIENT_NAME": F.col("patient_name"), "DOB": F.col("date_of_birth"), "THERAPY_1": F.lit("Physical therapy"), "CODE_1": F.lit("M17.11")}
    found = records(spark, sf)
    whole = [c for c in found.columns if c != "case_id"]
    rows = found.select("case_id", F.struct(*whole).alias("record"), F.filter(F.array(*[entry(k, v) for k, v in values.items()]), lambda t: t["raw"].isNotNull()).alias("tokens"))
    masked = deid.masked_record(rows, "record", "tokens").withColumn("masked", F.regexp_count(F.to_json("record"), F.lit(r"\[(?:PATIENT_NAME|DOB|THERAPY_1|CODE_1)\]")))
    back = deid.reidentified_record(masked, "record", "tokens")
    listed = F.array_join(F.transform("record.treatments", lambda t: F.concat(t["treatment"], F.lit(":"), t["dates"])), "|")
    return back.select("case_id", "record.patient_name", "record.date_of_birth", "record.bmi", listed.alias("treatments"),
                       F.array_join("record.diagnosis_codes", "|").alias("diagnosis_codes"), "record.imaging.modality", F.col("masked").cast("bigint").alias("masked"))


@query("latency_sketch", f"""WITH {cte('product_events')}
SELECT json_extract_string(props, '$.payer') AS payer, count(json_extract_string(props, '$.duration_ms')) AS n, q::DOUBLE AS quantile, true AS within
FROM product_events CROSS JOIN (VALUES (0.1), (0.5), (0.99)) v(q) WHERE event = 'pa_generation_succeeded' GROUP BY 1, 3""")
def latency_sketch(spark, sf):
    """Quantiles of each payer's latency from mergeable sketches, and whether their true rank is off by 1 % at most."""
    return ev.latency_quantiles(bound(spark, sf, "product_events"), [0.1, 0.5, 0.99]).select("payer", "n", "quantile", "within")


def _place(spark) -> str:
    return f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


@query("stored_memberships", f"""WITH {cte('memberships')}
SELECT id, org_id, user_id, CASE WHEN id % 4 = 0 THEN 'owner' ELSE role END AS role FROM memberships WHERE id % 3 <> 0 OR id % 4 = 0""")
def stored_memberships(spark, sf):
    """Two thirds of the memberships stored, then every fourth made owner or added, twice over as after a failure."""
    rows, path = bound(spark, sf, "memberships"), _place(spark)
    keyed.create(rows.where("id % 3 <> 0"), path, "id", 16)
    for _ in range(2):
        keyed.upsert(rows.where("id % 4 = 0").withColumn("role", F.lit("owner")), path, "id", 16)
    return keyed.read(spark, path)


@query("stored_signups", f"""WITH {cte('waitlist')}, w AS (SELECT lower(trim(raw_email)) AS email, id, created_s FROM waitlist WHERE trim(raw_email) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY email, id >= 700 ORDER BY created_s, id) AS k FROM w)
SELECT email, id, created_s FROM r WHERE k = 1 AND (id < 700 OR email NOT IN (SELECT email FROM w WHERE id < 700))""")
def stored_signups(spark, sf):
    """Signups under a unique address in two loads; an address that is stored keeps its row."""
    rows = bound(spark, sf, "waitlist").select(F.lower(F.trim("raw_email")).alias("email"), "id", "created_s").where("email <> ''")
    rows = rows.withColumn("first", F.struct((-F.col("created_s")).alias("a"), (-F.col("id")).alias("b")))
    path = _place(spark)
    keyed.create(rows.where("id < 700"), path, "email", 16, "first")
    for _ in range(2):
        keyed.upsert(rows.where("id >= 700"), path, "email", 16, "first", replace=False)
    return keyed.read(spark, path).select("email", "id", "created_s")


@query("usage_appended_once", f"""WITH {cte('pa_cases')}
SELECT org_id, strftime(created_at, '%Y-%m') AS period, count(*) AS n FROM pa_cases GROUP BY 1, 2""")
def usage_appended_once(spark, sf):
    """Usage rows in three batches, each appended twice, counted by organization and month."""
    rows, path = bound(spark, sf, "pa_cases").withColumn("period", F.date_format("created_at", "yyyy-MM")), _place(spark)
    for batch in (0, 1, 0, 2, 1, 2):
        ledger.append_once(rows.where(F.col("id") % 3 == batch), path, "usage", str(batch), "period")
    return ledger.read(spark, path).groupBy("org_id", F.col("period").cast("string").alias("period")).agg(F.count("*").alias("n"))
