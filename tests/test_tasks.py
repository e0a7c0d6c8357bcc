"""How the work of heavy tables is dealt over tasks, and that no plan does it twice."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from clearcase import bindings
from clearcase.operators import deid
from clearcase.operators import letters as lt


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_follow_rows_and_not_bytes(spark, sf, monkeypatch):
    monkeypatch.setattr(bindings, "TASK_ROWS", 40)
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    tasks = -(-orders // 40)
    assert tasks > spark.sparkContext.defaultParallelism
    assert bindings.bound(spark, sf, "raw_extractions").rdd.getNumPartitions() == tasks
    assert bindings.bound(spark, sf, "drafts").rdd.getNumPartitions() == tasks


def test_letters_meet_their_records_without_moving(spark, sf):
    shown = physical(queries()["letter_ungrounded_doses"](spark, sf))
    assert "SortMergeJoin" in shown and "ENSURE_REQUIREMENTS" not in shown


def test_durations_parse_each_extraction_once(spark, sf):
    assert plan(queries()["duration_parsing"](spark, sf)).count("Relation [") == 1


def test_case_tokens_search_each_text_once(spark, sf):
    assert "regexp_extract_all" not in plan(queries()["case_token_numbers"](spark, sf))


def test_cached_fixes_deal_out_one_patient(spark, sf):
    shown = plan(queries()["cached_fixes"](spark, sf))
    assert "_salt" in shown and "from_json" not in shown


def test_tokens_of_a_record_are_ordered_once(spark):
    token = "struct('X' AS cat, 1 AS n, '[{0}]' AS token, '{1}' AS raw, CAST(NULL AS STRING) AS key)"
    rows = spark.sql(f"SELECT struct(array('Ann Lee', 'ANN LEE met ann', 'x', null) AS a, 'Ann' AS b, 3 AS c) AS record, "
                     f"array({token.format('A', 'Ann')}, {token.format('B', 'Ann Lee')}, {token.format('C', 'x')}) AS tokens")
    masked = deid.masked_record(rows, "record", "tokens")
    back = deid.reidentified_record(masked, "record", "tokens")
    assert plan(masked).count("array_sort") == 1 and plan(back).count("array_sort") == 2
    got = masked.select("record.*").first()
    assert list(got.a) == ["[B]", "[B] met [A]", "x", None] and (got.b, got.c) == ("[A]", 3)
    assert list(back.select(F.col("record.a")).first().a) == ["Ann Lee", "Ann Lee met Ann", "x", None]


def test_long_projections_are_compiled(spark):
    """The JVM interprets a method above 8,000 bytes, which parsing a record or filling a letter would be as one stage."""
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        queries()["factor_failure_rates"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)


def test_labels_of_any_case_and_payers_with_signs_are_filled(spark):
    texts = ["x\r\n[date]\nUHC (a\\b)\n [ADDRESS]\n[City, State, ZIP]", "uhc (A\\B)\n\n[ADDRESS]\n[City,  State, ZIP]\n[Payer Name] [MD/do]", "[ADDRESS]", None, ""]
    rows = [(i, t, "N", "1", " UHC (a\\b) ", "P", None, "c", "r", "May $1") for i, t in enumerate(texts)]
    names = "id long, letter string, patient_name string, date_of_birth string, payer_name string, provider_name string, practice_name string, cpt_code string, requested_procedure string, letter_date string"
    done = [r.letter for r in lt.filled(spark.createDataFrame(rows, names)).orderBy("id").collect()]
    assert done == ["x\nMay $1\nUHC (a\\b)\nPrior Authorization Department", "uhc (A\\B)\n\nPrior Authorization Department\nUHC (a\\b) MD", "UHC (a\\b)", None, ""]


def test_texts_without_a_hint_are_not_searched_and_no_match_is_lost(spark):
    texts = ["JAN - FEB 2024, sept. 3rd, 2023; 4TH OF MAY 2024; 3 March 2024; x.a-b@c.de %q@r.st (212) 555-0147 1.2.3.4 p.o.box  7 LATE 2023", "AB-12-CD 123-45-6789 2024-01-02 1/2/24 06/2024 May of 2024",
             "9 Oak Hill Rd. Suite 4 St Ann's Clinic; Dr\tX-Ray Lee, D.O. and Ann B. Cole,\tPA-C; 99 YEAR OLD https://a.b/c", "éDr. Ann 1é23-45-6789", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = deid.spans(rows, "id", "text", *deid.SPAN_PATTERNS)
    assert plan(found).lower().count("rlike") == len(deid.SPAN_PATTERNS)
    plain = [rows.select("id", F.lit(c).alias("category"), F.posexplode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("pos", "raw")) for c, p in deid.SPAN_PATTERNS.items()]
    want = sorted(tuple(r) for df in plain for r in df.collect())
    assert sorted(tuple(r) for r in found.collect()) == want and {w[1] for w in want} == set(deid.SPAN_PATTERNS)
    ranges = deid.deidentify(rows.where("id = 0"), "text").first().tokens
    assert "JAN - FEB 2024" in [t.raw for t in ranges]
