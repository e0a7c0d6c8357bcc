"""Small exact cases, stated by hand."""

import hashlib
import hmac
import os

import pytest
from pyspark.sql import functions as F

from clearcase import fixed_values as fv
from clearcase.functions import text as tx
from clearcase.operators import access as ac
from clearcase.operators import letters as lt
from clearcase.operators import normalize as nz
from clearcase.operators import rules as rl
from clearcase.operators import scoring as sc
from clearcase.operators import usage
from clearcase.sources import charts as ch
from clearcase.sources import extractions as ex
from clearcase.sources import tables as tb


def values(spark, pairs, fn):
    df = spark.createDataFrame([(a,) for a, _ in pairs], "v STRING")
    return [r[0] for r in df.select(fn("v")).collect()]


@pytest.mark.parametrize("fn, pairs", [
    (tx.payer_weeks, [("≥6 weeks", 6), ("3 months", 13), ("Documented trial", 0), ("12 or 24 weeks depending on age/BMI", 24), ("1.5 months", 6), (None, 0)]),
    (tx.has_duration, [("10 sessions", True), ("3+ years", True), ("several years", False), (None, False)]),
    (tx.canonical_date, [("June 2024", "2024-06"), ("06/2024", "2024-06"), ("June 15, 2024", "2024-06-15"), ("6/5/24", "2024-06-05"), ("Smarch 2024", None), ("2024-06-05", None)]),
    (rl.payer_id_of, [("anthem / empire bcbs", "anthem_empire"), ("Blue Cross Blue Shield", "anthem_empire"), ("Aetna PPO", "aetna"), ("Humana", None), (" ", None)]),
    (tx.signature_name, [("Dr. Sarah Chen", "Sarah Chen, MD"), ("Luis Ortega DO", "Luis Ortega DO"), ("A. Lee M.D.", "A. Lee M.D.")]),
    (tx.surname_key, [("Dr. Chen", "chen"), ("Sarah Chen, MD", "chen"), ("Amy Park, PA-C", "park")]),
    (tx.anchor_slug, [("Letter: 3+ years of pain and more words", "Letter3yearsofpainandmore"[:24])]),
    (lt.without_heading, [("# Letter of Medical Necessity\n\nBody\n\n\n\nEnd", "Body\n\nEnd")]),
])
def test_scalar_functions(spark, fn, pairs):
    assert values(spark, pairs, lambda c: fn(F.col(c))) == [w for _, w in pairs]


def test_symptom_weeks(spark):
    # The unit must follow the number; a hyphen between them finds nothing.
    got = values(spark, [("2-year history", 0), ("10 weeks", 0), ("90 days", 0), ("3+ years", 0), (None, 0)], tx.symptom_weeks)
    assert got == [None, 10.0, pytest.approx(90 / 7), 156.0, None]


def test_candidate_phrases_and_negation(spark):
    df = spark.createDataFrame([("Weight management (if BMI ≥30)", "no recent"), ("NSAIDs or acetaminophen / ice or x", "patient has denied any such thing at all and")], "r STRING, p STRING")
    got = df.select(rl.candidate_phrases(F.col("r")), rl.negated_before(F.col("p"))).collect()
    assert got[0][0] == ["weight management"] and got[1][0] == ["nsaids", "acetaminophen", "ice"]
    assert got[0][1] is True and got[1][1] is False


def test_name_variants_longest_first(spark):
    parts = tx.name_parts(F.lit("O'Brien-Smith, Siobhan K. Jr."))
    got = spark.range(1).select(tx.name_variants(parts)).first()[0]
    assert got[0] == "O'Brien-Smith, Siobhan K. Jr" and "Smith" in got and "Siobhan" in got and "Mr. O'Brien-Smith" in got
    assert [len(v) for v in got] == sorted((len(v) for v in got), reverse=True)


def test_billing(spark):
    surgeons = spark.createDataFrame([("s1", 1, "A", True), ("s2", 1, "B", True), ("s3", 1, "C", False)], "id STRING, org_id INT, full_name STRING, active BOOLEAN")
    cases = spark.createDataFrame([(s, "2026-07-19") for s in ("s1", "s1", "s2", "s3")] + [("s1", "2026-08-01")], "surgeon_id STRING, d STRING").withColumn("created_at", F.to_timestamp("d"))
    orgs = spark.createDataFrame([(1, 2), (2, 0)], "id INT, last_acknowledged_surgeon_count INT")
    bills = {r.org_id: r for r in usage.billing_for_period(orgs, surgeons, cases, "2026-07-01", "2026-08-01").collect()}
    assert (bills[1].active_surgeons, bills[1].total_cases, bills[1].amount_cents) == (2, 4, (199 + 160) * 100)
    assert (bills[2].active_surgeons, bills[2].total_cases, bills[2].amount_cents) == (0, 0, 19900)
    assert [r.n for r in spark.createDataFrame([(5,), (10,), (15,)], "k INT").select(usage.group_price_cents(F.col("k")).alias("n")).collect()] == [59900, 99900, 139900]


def test_keyed_hash_equals_hmac(spark):
    got = spark.range(1).select(tx.keyed_hash(F.lit("  Marcus WEBB "), "secret")).first()[0]
    assert got == hmac.new(b"secret", b"marcus webb", hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        tx.keyed_hash("x", "")


def test_rule_gate(spark):
    rules = rl.load_rules(spark)
    assert rules.count() == 12 and rules.where("validation_status = 'validated'").count() == 8
    for status, method, day in (("validated", "search_snippet", "2026-01-01"), ("validated", "direct_fetch_quoted", None), ("unvalidated", "unverified", "2026-01-01")):
        row = rl.default_rules()[0]
        with pytest.raises(ValueError):
            rl.load_rules(spark, [row[:4] + (status, method, day) + row[7:]])


def test_json_typing(spark):
    raw = '```json\n{"patient_name": 5, "diagnosis_codes": ["M17", 3, " "], "bmi": "about 31.5", "asa_classification": 3, "imaging_status": true,' \
          ' "conservative_treatments_attempted": ["PT \\"home\\"", 7, {"name": "Ice"}], "denial_risk_flags": ["Short course. Add dates"],' \
          ' "pa_strength": {"diagnosis_codes": {"score": "1"}, "surgical_approach": {"score": 1.0}}}\n```'
    df = spark.createDataFrame([(1, raw), (2, '{"a": 1} and {"b": 2}'), (3, "[1]")], "case_id INT, raw_json STRING")
    got = nz.normalized(ex.records_of(df)).collect()
    assert [r.case_id for r in got] == [1] and {r.case_id for r in ex.rejects_of(df).collect()} == {2, 3}
    r = got[0]
    assert r.patient_name is None and r.diagnosis_codes == ["M17"] and r.bmi == 31.5 and r.asa_classification == "3" and r.imaging_status == "not_ordered"
    assert [t.treatment for t in r.treatments] == ['PT "home"', "Unknown Treatment", "Ice"]
    assert r.risk_flags[0].label == "Short course" and r.risk_flags[0].explanation == "Short course. Add dates"
    assert r.judged_diagnosis.score == 0 and r.judged_approach.score == 1


def test_penalty_only_lowers(spark, sf):
    from clearcase.plans.case_queries import records

    scored = sc.scored(records(spark, sf))
    before = scored.select("case_id", F.col("strength.conservative_treatment_duration.score").alias("a"))
    after = rl.with_payer_results(scored, rl.load_rules(spark))
    both = before.join(after.select("case_id", "checklist", "validation_status", F.col("strength.conservative_treatment_duration.score").alias("b")), "case_id")
    assert both.where("b > a").count() == 0
    assert both.where((F.col("validation_status") != "validated") & F.exists("checklist", lambda i: i["verdict"] != "unverifiable")).count() == 0


def test_duplicate_signature_and_placeholders(spark):
    twice = "Body\n\nSincerely,\nSarah Chen, MD\nNPI 1\n\nRe: again\nBody\n\nSincerely,\nSarah Chen"
    cut, doubled = lt.duplicate_removed(F.col("v"))
    rows = spark.createDataFrame([(twice,), ("Body\n\nSincerely,\nX",)], "v STRING").select(cut, doubled).collect()
    assert rows[0][0] == "Body\n\nSincerely,\nSarah Chen, MD\nNPI 1" and rows[0][1] is True
    assert rows[1][0] == "Body\n\nSincerely,\nX" and rows[1][1] is False
    case = spark.createDataFrame([("Aetna\n\n[ADDRESS]\n[City, State, ZIP]\n[DATE]\nRe: [Patient  Name] [Foo]", "Ann $1 Lee", None, "Aetna", "Dr. Chen", None, "27447", None, "May 1, 2024")],
                                 "letter STRING, patient_name STRING, date_of_birth STRING, payer_name STRING, provider_name STRING, practice_name STRING, cpt_code STRING, requested_procedure STRING, letter_date STRING")
    assert lt.filled(case).first().letter == "Aetna\n\nPrior Authorization Department\nMay 1, 2024\nRe: Ann $1 Lee [Foo]"
    kept = spark.range(1).select(lt.without_bracket_lines(F.lit(f"a\n{fv.SAFETY_MARKER} b\n[x]\nc"))).first()[0]
    assert kept == f"a\n{fv.SAFETY_MARKER} b\nc"


def test_files_appends_and_settling(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.txt", b"x" * 120), ("b.txt", b"short"), ("c.pdf", b"%PDF-1.7 ..."), ("d.pdf", b"nope"), ("e.docx", b"PK\x03\x04zip"), ("f.rtf", b"x")):
        (tmp_path / "in" / name).write_bytes(body)
    got = {r.path[-5:]: r.rejected for r in ch.gated(ch.read_files(spark, str(tmp_path / "in"))).collect()}
    assert got == {"a.txt": None, "b.txt": "short", "c.pdf": None, "d.pdf": "magic", ".docx": None, "f.rtf": "type"} or got["a.txt"] is None and got["f.rtf"] == "type"
    assert {r.text for r in ch.read_texts(spark, str(tmp_path / "in" / "*.txt")).collect()} == {"x" * 120, "short"}
    rows = spark.createDataFrame([(1, "2024-05-03")], "id INT, d STRING").withColumn("created_at", F.to_timestamp("d"))
    for _ in range(2):
        tb.append_usage(rows, str(tmp_path / "usage"))
    back = spark.read.parquet(str(tmp_path / "usage"))
    assert back.count() == 2 and back.first().period == "2024-05"
    assert tb.settled(rows).count() == 1


def test_registry_is_broadcast_by_its_size_and_first_rule_counts(spark, sf):
    from clearcase.plans.case_queries import records

    def ran(rows=None):
        df = rl.with_rule(records(spark, sf), rl.load_rules(spark, rows))
        return df.select("case_id", "case_payer_id", "validation_status").collect(), df

    plain, df = ran()
    own = rl.default_rules()
    doubled, _ = ran([*own, *[(*row[:3], "a later rule", *row[4:]) for row in own]])
    assert sorted(plain) == sorted(doubled) and len(plain) == records(spark, sf).count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled, other = ran()
        assert sorted(shuffled) == sorted(plain) and "BroadcastHashJoin" not in other._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_last_supplement_counts(spark):
    rows = [(1, "symptom_duration", "9 weeks", 1), (1, "symptom_duration", "10 weeks", 2), (1, "unknown", "x", 3), (1, "surgical_approach", " ", 4)]
    got = nz.supplement_map(spark.createDataFrame(rows, "case_id LONG, key STRING, value STRING, seq INT")).collect()
    assert [(r.case_id, r.supplements) for r in got] == [(1, {"symptom_duration": "10 weeks"})]


def test_batches_of_string_keys(spark):
    ids = [f"k{(i * 7919) % 1000:04d}" for i in range(173)]
    got = usage.send_batches(spark.createDataFrame([(i,) for i in ids], "id STRING").repartition(5), "id", 50).collect()
    assert {r.id: r.batch for r in got} == {i: k // 50 for k, i in enumerate(sorted(ids))}


def test_last_update_counts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, v STRING")
    updates = spark.createDataFrame([(1, "z", 1), (1, "c", 2)], "id INT, v STRING, at INT")
    assert sorted(tuple(r) for r in ac.keyed_update(rows, "id", updates, "v", "at").collect()) == [(1, "c"), (2, "b")]


def test_owned_tables_are_deleted(spark):
    with tb.owned(spark):
        path = tb.settled(spark.range(3)).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def test_limitation_claims_and_anchor_runs(spark):
    from clearcase.operators import grounding as gr

    letter = ("The patient is unable to climb stairs. She has difficulty with overhead lifting of boxes. "
              "He cannot dance at weddings. Activities of daily living: cannot perform them.")
    df = spark.createDataFrame([(letter, ["Unable to climb stairs without rail", "limited overhead lifting"])], "letter STRING, functional_limitations ARRAY<STRING>")
    got = gr.ungrounded_limitations(df, "letter", "functional_limitations").first().limitations_missing
    assert got == ['"cannot dance at weddings"  (sentence: He cannot dance at weddings.)']
    marks = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(a).alias("anchor")) for i, a in (("b", "stairs. She"), ("a", "climb stairs"), ("c", "absent"), ("d", "dance"))])
    runs = df.select(lt.anchor_runs(F.col("letter"), marks)).first()[0]
    assert [(r.item_id, letter[r.start:r.start + r.len]) for r in runs] == [("a", "climb stairs"), ("d", "dance")]
