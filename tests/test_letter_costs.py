"""What a letter's checks cost, and that dates are found as the plain patterns find them."""

import random
import re
import time

from pyspark.sql import functions as F

from clearcase import fixed_values as fv
from clearcase.functions import text as tx
from clearcase.operators import grounding as gr
from clearcase.operators import letters as lt
from clearcase.plans import letter_queries as lq

SHAPE = ("letter string, facts string, functional_limitations array<string>, surgical_approach string, treatments array<struct<treatment:string>>, "
         "imaging struct<modality:string>, letter_date string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def letters(spark, text):
    return spark.createDataFrame([(text, "", ["cannot climb stairs"], None, [], None, "")], SHAPE).repartition(1)


def test_source_lock_tests_substrings_by_first_bytes(spark):
    assert "instr(" not in plan(gr.source_lock(letters(spark, "The patient takes 500 mg.")))


def test_evaluation_lowers_a_letter_once(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    assert plan(gr.evaluation_violations(letters(spark, "The patient cannot dance."))).count("lower(letter#") == 1


def test_absence_language_in_long_sentences(spark):
    """A sentence without an end was searched to its end from each of its characters."""
    text = "word " * 40_000 + "\nThe date is not recorded. No."
    start = time.time()
    left = spark.createDataFrame([(text,)], "t string").select(lt.without_absence_language(F.col("t"))).first()[0]
    assert left == "word " * 40_000 + "\n No." and time.time() - start < 20


def test_dates_are_found_as_by_plain_patterns(spark):
    rng = random.Random(3)
    words = [*fv.MONTH_NAMES, "may", "JUNE", "Juneau", "xMay", "2024", "5,", "15", "1/2/24", "01-02-2024", "12/2023", "2024-01-05", "12024-01-05", "2024-01-055", "late", "Early", "plate",
             "12 weeks", "5months", "2 days", "1 year", "x3 week", "of"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ". ", ", ", "", "\n"]) for _ in range(30)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for own, plain in ((tx.find_all("t", *tx.LETTER_DATES, tx.DURATION), lq.LETTER_DATES), (tx.find_all("t", *tx.RECORD_DATES), lq.RECORD_DATES)):
        for text, found in df.select("t", own).collect():
            assert found == [m.group(0) for p in plain for m in re.finditer(p, text, re.ASCII)], text
