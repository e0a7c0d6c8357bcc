"""Plans of queries that join derived texts: nothing is sent whole through the driver, no list is worked out twice."""

import pytest

from __spark_entry__ import queries

# Queries that join letters, charts or records by a key.
GROWING = [
    "letter_ungrounded_dates", "letter_changed_paragraphs", "record_extraction_warnings", "record_chart_discrepancies",
    "expectation_checks", "expectation_summary", "letter_ungrounded_terms", "letter_ungrounded_doses",
]


def plan(spark, sf, name):
    return queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", GROWING)
def test_growing_sides_are_not_broadcast(spark, sf, name):
    assert "BroadcastHashJoin" not in plan(spark, sf, name)


def test_claims_are_found_once(spark, sf):
    text = plan(spark, sf, "letter_ungrounded_dates")
    assert text.count("regexp_extract_all(letter") == 6  # five shapes of dates and the durations


def test_claims_of_sentences_with_and_without_claim_words(spark):
    from clearcase.operators import grounding as gr

    said = ["Unable to kneel down today", "REQUIRES HELP with dressing", "relies on a cane daily", "Limited capacity to reach up", "The knee hurts.",
            "cannot perform activities of daily living", "difficulty with stairs"]
    rows = spark.createDataFrame([(said,)], "s array<string>")
    found = rows.select(gr.claims_of(rows["s"], gr.LIMITATION_CLAIMS).alias("c")).first()["c"]
    assert [c["claim"] for c in found] == ["kneel down today", "dressing", "a cane daily", "reach up", "stairs"]
    assert "require|relie" in plan(spark, "/root/testdata/sf0.001", "letter_ungrounded_limitations")
