"""Queries over text: de-identification, span tables, leak verification."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clearcase import fixed_values as fv
from clearcase.bindings import bound, cte, table
from clearcase.functions import text as tx
from clearcase.operators import deid, seams
from clearcase.operators import verify as vf
from clearcase.plans.registry import query
from clearcase.sources.tables import keyed, settled

_M = "(?:" + "|".join(fv.MONTH_NAMES) + ")"

# Patterns as RE2 reads them: its \b has ASCII word edges, like the ones we spell out.  Streets are stated apart from the
# operator's own form.
_STREET_KINDS = "Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Ln|Way|Court|Ct|Place|Pl"
_STREET_LINE = rf"\b\d{{1,5}}\s+[A-Z][a-zA-Z]+(?:\s+[A-Za-z]+)*\s+(?:{_STREET_KINDS})\.?"
RE2 = {
    "ssn": deid.SSN, "phone": deid.PHONE, "email": deid.EMAIL, "url": deid.URL, "ip": deid.IPV4, "address": _STREET_LINE + r"(?:\s+(?:Suite|Ste|Apt|Unit)\.?\s*[A-Z0-9]+)?\b",
    "po_box": r"(?i)\bP\.?\s?O\.?\s*Box\s+\d+\b", "age": r"(?i)\b\d{1,3}[- ]year[- ]old\b", "facility": deid.FACILITY,
    "provider_titled": r"\bDr\.?[ \t]+[A-Z][a-zA-Z'\-]+(?:[ \t]+[A-Z][a-zA-Z'\-]+)?\b",
    "provider_credentialed": r"\b[A-Z][a-zA-Z'\-]+(?:[ \t][A-Z]\.?)?(?:[ \t][A-Z][a-zA-Z'\-]+)?,?[ \t]+(?:MD|D\.?O\.?|PA-C|NP|RN|DPM)\b",
    "bare_id": deid.BARE_ID,
    **{f"date_{n.replace(' ', '_')}": p for n, p, _ in deid.DATES},
}


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def spans_sql(source: str, key: str, text: str, *names: str) -> str:
    parts = [f"SELECT {key}, '{n}' AS category, regexp_extract_all({text}, {lit(RE2[n])}) AS h FROM {source}" for n in names]
    return f"SELECT {key}, category, k - 1 AS pos, h[k] AS raw FROM ({' UNION ALL '.join(parts)}) CROSS JOIN range(1, 100000) g(k) WHERE k <= len(h)"


def exploded_sql(source: str, key: str, text: str, *names: str) -> str:
    """Matches by unnest, one row each (no bound on matches per text)."""
    parts = [f"SELECT {key}, '{n}' AS category, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS raw FROM (SELECT {key}, regexp_extract_all({text}, {lit(RE2[n])}) AS h FROM {source})"
             for n in names]
    return " UNION ALL ".join(parts)


ID_SPANS = ("ssn", "phone", "email", "url", "ip", "address", "po_box", "age", "bare_id")
DATE_SPANS = tuple(n for n in RE2 if n.startswith("date_"))
NAME_SPANS = ("facility", "provider_titled", "provider_credentialed")


def _as_long(df):
    return df.withColumn("pos", F.col("pos").cast("bigint"))


@query("document_identifier_spans", exploded_sql("documents", "doc_id", "text", *ID_SPANS, *DATE_SPANS, *NAME_SPANS))
def document_identifier_spans(spark, sf):
    return _as_long(deid.spans(table(spark, sf, "documents"), "doc_id", "text", *ID_SPANS, *DATE_SPANS, *NAME_SPANS))


@query("chart_identifier_spans", f"WITH {cte('charts')} {exploded_sql('charts', 'chart_id', 'text', *ID_SPANS)}")
def chart_identifier_spans(spark, sf):
    return _as_long(deid.spans(bound(spark, sf, "charts"), "chart_id", "text", *ID_SPANS))


@query("chart_date_spans", f"WITH {cte('charts')} {exploded_sql('charts', 'chart_id', 'text', *DATE_SPANS)}")
def chart_date_spans(spark, sf):
    return _as_long(deid.spans(bound(spark, sf, "charts"), "chart_id", "text", *DATE_SPANS))


@query("chart_name_spans", f"WITH {cte('charts')} {exploded_sql('charts', 'chart_id', 'text', *NAME_SPANS)}")
def chart_name_spans(spark, sf):
    return _as_long(deid.spans(bound(spark, sf, "charts"), "chart_id", "text", *NAME_SPANS))


@query("page_url_spans", exploded_sql("pages", "page_id", "html", *ID_SPANS, *DATE_SPANS, *NAME_SPANS))
def page_url_spans(spark, sf):
    return _as_long(deid.spans(table(spark, sf, "pages"), "page_id", "html", *ID_SPANS, *DATE_SPANS, *NAME_SPANS))


_NUMBERED = f"""WITH {cte('charts')}, sp AS ({exploded_sql('charts', 'chart_id', 'text', 'phone', 'ssn', 'provider_titled')}),
f AS (SELECT *, min(pos) OVER (PARTITION BY chart_id, category, lower(trim(raw))) AS first_pos FROM sp),
n AS (SELECT chart_id, category, pos, raw, row_number() OVER (PARTITION BY chart_id, category ORDER BY pos) AS occurrence,
             dense_rank() OVER (PARTITION BY chart_id, category ORDER BY first_pos) AS value_no FROM f)
"""


def _numbered(spark, sf, start=None):
    found = deid.spans(bound(spark, sf, "charts"), "chart_id", "text", "phone", "ssn", "provider_titled")
    return _as_long(deid.numbered_spans(found, "chart_id", start)).select(
        "chart_id", "category", "pos", "raw", F.col("occurrence").cast("bigint").alias("occurrence"), F.col("value_no").cast("bigint").alias("value_no"))


@query("token_numbers", _NUMBERED + "SELECT * FROM n")
def token_numbers(spark, sf):
    return _numbered(spark, sf)


@query("token_numbers_continued", _NUMBERED + """
SELECT chart_id, category, pos, raw, occurrence + CASE WHEN category = 'ssn' THEN chart_id % 4 ELSE 0 END AS occurrence,
       value_no + CASE WHEN category = 'ssn' THEN chart_id % 4 ELSE 0 END AS value_no FROM n""")
def token_numbers_continued(spark, sf):
    """Numbers carry on after ``chart_id % 4`` tokens given earlier in each chart's case."""
    start = bound(spark, sf, "charts").select("chart_id", F.lit("ssn").alias("category"), (F.col("chart_id") % 4).alias("last"))
    return _numbered(spark, sf, start)


@query("vocabulary_hits", f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE word IN ({', '.join(repr(w) for w in sorted(set(fv.ALLOWLIST_SEED)))}) GROUP BY 1""")
def vocabulary_hits(spark, sf):
    """Occurrences of each allowlisted word in the corpus."""
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return words.where(F.col("word").isin(fv.ALLOWLIST_SEED)).groupBy("word").agg(F.count("*").alias("n"))


@query("deidentified_charts")
def deidentified_charts(spark, sf):
    done = deid.deidentify(bound(spark, sf, "charts"), "text")
    return done.select("chart_id", "redacted", F.size("tokens").alias("tokens"), "unclassified")


@query("chart_redaction_audit")
def chart_redaction_audit(spark, sf):
    done = settled(deid.deidentify(bound(spark, sf, "charts"), "text").select("chart_id", "tokens", "unclassified"))
    return deid.audit(done, "chart_id")


@query("document_leak_gate")
def document_leak_gate(spark, sf):
    """Whole documents de-identified, then searched by the independent detector."""
    done = vf.verified(settled(deid.deidentify(table(spark, sf, "documents"), "text").select("doc_id", "redacted", "tokens", "unclassified")))
    return done.select("doc_id", "clean", F.size("leaks").alias("leaks"), F.size("tokens").alias("tokens"), "unclassified")


@query("chart_round_trip")
def chart_round_trip(spark, sf):
    """Restored text holds every value of the token map again."""
    done = settled(deid.deidentify(bound(spark, sf, "charts"), "text").select("chart_id", "redacted", "tokens")).withColumn("restored", deid.reidentified(F.col("redacted"), F.col("tokens")))
    return done.select("chart_id", F.forall("tokens", lambda t: tx.contains(F.col("restored"), t["raw"])).alias("restored_all"),
                       tx.contains(F.col("restored"), F.lit("[REDACTED]")).alias("still_masked"))


def _turns(turns):
    return seams.shared(turns.select("conv_id", "turn", "text"), "conv_id", ["turn", "text"], "text").drop("text")


def redacted_turns(turns):
    """(conv_id, turn, redacted, tokens, unclassified) of every turn; ``tokens`` are all of the conversation so far, which
    is meant for short ones. ``seams.shared`` has each turn's own tokens and their number so far."""
    so_far = W.partitionBy("conv_id").orderBy("turn", "redacted").rowsBetween(W.unboundedPreceding, 0)
    done = _turns(turns).withColumn("all", F.flatten(F.collect_list("tokens").over(so_far)))
    first = F.filter("all", lambda t, i: F.array_position(F.transform("all", lambda x: x["token"]), t["token"]) == i + 1)
    return done.select("conv_id", "turn", "redacted", first.alias("tokens"), "unclassified")


@query("conversation_shared_tokens")
def conversation_shared_tokens(spark, sf):
    """All turns of each conversation share one numbering; tokens are those of the conversation so far."""
    return _turns(table(spark, sf, "conversations")).select("conv_id", "turn", "redacted", F.col("known").cast("int").alias("tokens"), "unclassified")


_SEAM_SPANS = ("phone", "email", "ssn", "ip", "date_iso", "date_numeric", "provider_titled", "facility")


@query("case_token_numbers", f"""WITH {cte('charts', 'drafts', 'raw_extractions')},
t AS (SELECT chart_id AS patient_id, 0 AS seam, chart_id AS item, text FROM charts
      UNION ALL SELECT r.chart_id, d.attempt, d.case_id, d.text FROM drafts d JOIN raw_extractions r ON d.case_id = r.case_id),
sp AS ({exploded_sql('t', 'patient_id, seam, item', 'text', *_SEAM_SPANS)}),
v AS (SELECT *, CASE WHEN category IN ('phone', 'email', 'ssn', 'ip') THEN NULL ELSE lower(trim(raw)) END AS value FROM sp),
f AS (SELECT *, min((seam, item, pos)) OVER (PARTITION BY patient_id, category, value) AS first_at FROM v WHERE value IS NOT NULL)
SELECT patient_id, seam, item, category, pos, raw, row_number() OVER (PARTITION BY patient_id, category ORDER BY seam, item, pos) AS number FROM v WHERE value IS NULL
UNION ALL SELECT patient_id, seam, item, category, pos, raw, dense_rank() OVER (PARTITION BY patient_id, category ORDER BY first_at) FROM f""")
def case_token_numbers(spark, sf):
    """Token numbers of identifiers over all texts of a patient: the chart first, then the drafts of the letters."""
    charts = bound(spark, sf, "charts").select(F.col("chart_id").alias("patient_id"), F.lit(0).cast("bigint").alias("seam"), F.col("chart_id").alias("item"), "text")
    drafts = bound(spark, sf, "drafts").join(keyed(bound(spark, sf, "raw_extractions").select("case_id", "chart_id")), "case_id").select(
        F.col("chart_id").alias("patient_id"), F.col("attempt").cast("bigint").alias("seam"), F.col("case_id").alias("item"), "text")
    texts = charts.unionByName(drafts).withColumn("at", F.struct("seam", "item"))
    found = _as_long(deid.spans(texts.withColumn("row", F.struct("patient_id", "at")), "row", "text", *_SEAM_SPANS)).select("row.patient_id", "row.at", "category", "pos", "raw")
    value = F.when(~F.col("category").isin("phone", "email", "ssn", "ip"), F.lower(F.trim("raw")))
    # Written once: the numbering reads its rows three times, and each time would search all texts again.
    done = seams.numbered(settled(found.withColumn("value", value)), "patient_id", "at", "pos")
    return done.select("patient_id", "at.seam", "at.item", "category", "pos", "raw", F.col("number").cast("bigint").alias("number"))


_COUNTS = {k: p.replace(tx.MONTH, _M) for k, (p, _) in vf.DETECTORS.items()} | {
    "address_street": rf"(?i){_STREET_LINE}\b|\bP\.?\s?O\.?\s*Box\s+\d+\b"}


@query("document_pattern_counts", "SELECT doc_id, " + ", ".join(
    f"len(regexp_extract_all(text, {lit(p)})) AS {k}" for k, p in _COUNTS.items()) + " FROM documents")
def document_pattern_counts(spark, sf):
    return vf.pattern_counts(table(spark, sf, "documents"), "doc_id", "text")


@query("chart_pattern_counts", f"WITH {cte('charts')} SELECT chart_id, " + ", ".join(
    f"len(regexp_extract_all(text, {lit(p)})) AS {k}" for k, p in _COUNTS.items()) + " FROM charts")
def chart_pattern_counts(spark, sf):
    return vf.pattern_counts(bound(spark, sf, "charts"), "chart_id", "text")


@query("folded_text", """SELECT doc_id, length(f) AS chars, f AS folded FROM (SELECT doc_id, translate(
  regexp_replace(text, '[\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}\\x{00AD}]', '', 'g'), '‘’‚“”„‒–—−' || chr(160) || chr(8239), '''''''''''''----  ') AS f FROM documents)""")
def folded_text(spark, sf):
    folded = table(spark, sf, "documents").select("doc_id", tx.fold_punctuation("text").alias("folded"))
    return folded.select("doc_id", F.length("folded").cast("bigint").alias("chars"), "folded")


@query("chart_intake", f"""WITH {cte('charts')}
SELECT chart_id, CASE WHEN NOT regexp_matches(lower(file_name), '\\.(pdf|docx|txt)$') THEN 'type'
  WHEN regexp_matches(lower(file_name), '\\.(pdf|docx)$') THEN 'magic' WHEN length(text) < 100 THEN 'short' END AS rejected FROM charts""")
def chart_intake(spark, sf):
    """Chart texts offered under their file names: a text is no PDF or DOCX, whatever it is called."""
    from clearcase.sources import charts as src

    files = bound(spark, sf, "charts").select("chart_id", F.col("file_name").alias("path"), F.encode("text", "UTF-8").alias("content"),
                                              F.octet_length("text").cast("bigint").alias("length"))
    return src.gated(files).select("chart_id", "rejected")
