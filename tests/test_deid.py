"""Redaction and verification of charts put together from known pieces, and of long texts of the worst shape."""

import re
import time

import pytest
from pyspark.sql import functions as F

from clearcase import fixed_values as fv
from clearcase.operators import deid
from clearcase.operators import letters as lt
from clearcase.operators import verify as vf
from clearcase.sources.tables import settled

CITY = fv.METRO_CITIES[3]

# A piece of text, what redaction must leave of it, and values that must be gone.
PIECES = {
    "labelled ssn": ("ssn - 604 22 9177.", "ssn: [SSN_1].", ["604 22 9177"]),
    "plain ssn": ("on file as 604-22-9177 since then.", "on file as [SSN_1] since then.", ["604-22-9177"]),
    "npi": ("NPI # 1093817465", "NPI #: [NPI_1]", ["1093817465"]),
    "dea": ("DEA: BK4471920", "DEA: [DEA_1]", ["BK4471920"]),
    "fax": ("Fax: (303) 555-0148", "Fax: [FAX_1]", ["555-0148"]),
    "phone": ("reach us at 303.555.0192 today", "reach us at [PHONE] today", ["555.0192"]),
    "mobile": ("mobile 3035550177", "mobile: [PHONE]", ["3035550177"]),
    "chart number": ("chart number: QX77120", "chart number: [MRN]", ["QX77120"]),
    "member": ("Member ID: HPQ-220-71", "Member ID: [MEMBERID_1]", ["HPQ-220-71"]),
    "plate": ("VIN: 8KLM201QQ", "VIN: [VEHICLE_1]", ["8KLM201QQ"]),
    "claim": ("claim # 7745AA", "claim: [ACCOUNT_1]", ["7745AA"]),
    "mail": ("write to r.okafor+clinic@mail.example.org please", "write to [EMAIL_1] please", ["okafor"]),
    "link": ("see https://files.example.net/x?y=1 there", "see [URL_1] there", ["files.example"]),
    "address": ("from 10.20.30.40 it came", "from [IP_1] it came", ["10.20.30.40"]),
    "birth": ("date of birth: 7/9/1958", "date of birth: [DOB]", ["1958"]),
    "iso": ("on 2023-11-05 it began", "on [DATE_1] it began", ["2023-11-05"]),
    "ordinal": ("on the 3rd of March, 2022 it began", "on the [DATE_1] it began", ["March"]),
    "range": ("therapy April-September 2023 helped", "therapy [DATE_1] helped", ["April", "September"]),
    "season": ("it was late 2021 then", "it was [DATE_1] then", ["2021"]),
    "short date": ("injury 9/14 noted", "injury [DATE_1] noted", ["9/14"]),
    "grades": ("strength 3/5 and pain 6/10, ratio 11/12", "strength 3/5 and pain 6/10, ratio 11/12", []),
    "box": ("send to PO Box 771", "send to [ADDRESS]", ["771"]),
    "street": ("lives at 48 Old Mill Pond Road Apt 6B now", "lives at [ADDRESS] now", ["Mill"]),
    "wide zip": ("near Fargo, ND" + " " * 12 + "58102 he works", "near [CITY_1], ND" + " " * 12 + "[ZIP_1] he works", ["Fargo", "58102"]),
    "long zip": ("near Fargo,\n   ND 58102-4417 he works", "near [CITY_1], ND [ZIP_1] he works", ["58102"]),
    "older": ("a 97-year-old woman", "a [AGE_90PLUS] woman", ["97"]),
    "age": ("a 61 year old woman", "a [AGE] woman", ["61"]),
    "clinic": ("seen in Pine Ridge Clinic then", "seen in [FACILITY] then", ["Pine"]),
    "doctor": ("with Dr. Amara Osei again", "with [PROVIDER_1] again", ["Osei"]),
    "credential": ("by Tomas Ruiz, NP again", "by [PROVIDER_1], NP again", ["Ruiz"]),
    "metro": (f"she knows {CITY} well", "she knows [CITY_1] well", [CITY]),
    "wide honorific": ("with Mrs." + " " * 7 + f"{CITY} present", None, []),
    "kin": ("next of kin: Hana Sato", "next of kin: [CONTACT_1]", ["Hana", "Sato"]),
    "case id": ("under TR9-K21-44 there", "under [ACCOUNT_1] there", ["TR9-K21-44"]),
    "levels": ("between L2-L3 with code 29881-59", "between L2-L3 with code 29881-59", []),
    "digits": ("value 770155018823 is odd", "value [REDACTED] is odd", ["770155018823"]),
    "unknown": ("the plan of Zuberi Mwangi holds", "the plan of [REDACTED] holds", ["Zuberi"]),
    "nothing": ("", "", []),
}
NAMED = "Patient: Ilse van Doorn\nIlse reports pain. Ms. Doorn walks. DOB: 2/2/1970"


@pytest.fixture(scope="module")
def done(spark):
    rows = [*((n, t) for n, (t, _, _) in PIECES.items()), ("named", NAMED)]
    out = vf.verified(settled(deid.deidentify(spark.createDataFrame(rows, "name STRING, text STRING").repartition(4), "text")))
    out = out.withColumn("back", deid.reidentified(F.col("redacted"), F.col("tokens")))
    return {r.name: r for r in out.collect()}


@pytest.mark.parametrize("name", PIECES)
def test_piece(done, name):
    text, expected, gone = PIECES[name]
    row = done[name]
    if expected is not None:
        assert re.sub(r"\s+", " ", row.redacted) == re.sub(r"\s+", " ", expected)
    assert not any(value in row.redacted for value in gone)
    assert row.clean, row.leaks
    assert all(t.raw in row.back for t in row.tokens) and len({t.token for t in row.tokens}) == len(row.tokens)


def test_a_name_is_not_a_city(done):
    assert "[CITY" not in done["wide honorific"].redacted


def test_the_patient_in_every_form(done):
    row = done["named"]
    assert "Ilse" not in row.redacted and "Doorn" not in row.redacted and row.redacted.count("[PATIENT_NAME]") >= 2


def test_masked_digits_stay_masked(done):
    row = done["digits"]
    assert "[REDACTED]" in row.back and not any("770155018823" in t.raw for t in row.tokens)


LEAKS = [
    ("ssn", "was 771-20-4466 before", [("[SSN_1]", "000-11-2222")], ("ssn", 4)),
    ("echo", "blue kite here, blue kite there", [("[THING_1]", "blue kite")], ("map_value_THING", 16)),
    ("email", "ask q@r.example.com", [], ("email", 4)),
    ("label", "see DOB: 1", [], ("labeled_identifier_residue", 4)),
    ("digits", "no 123123123123", [], ("digit_run", 3)),
    ("name", "then okoye left", [("[PATIENT_NAME]", "Ada Okoye")], ("patient_name_variant", 5)),
    ("contact", "by lena brandt", [("[CONTACT_1]", "Lena Brandt")], ("contact_name_variant", 3)),
    ("none", "[PHONE] at [DATE_3] and [REDACTED]", [], None),
]


def test_planted_leaks(spark):
    rows = [(n, t, [(None, 1, k, v, None) for k, v in m]) for n, t, m, _ in LEAKS]
    df = spark.createDataFrame(rows, f"name STRING, redacted STRING, tokens {deid.TOKENS}")
    found = {r.name: [(x.category, x.offset) for x in r.leaks] for r in vf.verified(df).collect()}
    for name, _, _, leak in LEAKS:
        assert (leak in found[name]) if leak else found[name] == [], (name, found[name])
    assert found["echo"] == [("map_value_THING", 0), ("map_value_THING", 16)]


def test_texts_of_one_case_share_numbers(spark):
    df = spark.createDataFrame([("Patient: Noor Haddad, on 2021-05-06", "Haddad was seen 7/8/2022.")], "a STRING, b STRING")
    first = settled(deid.deidentify(df, "a", out="a_out").withColumnRenamed("tokens", "known").drop("unclassified"))
    second = deid.deidentify(first, "b", tokens="known", out="b_out").first()
    assert "[DATE_1]" in second.a_out and second.b_out == "[PATIENT_NAME] was seen [DATE_2]."
    again = first.select(
        deid.known_values_masked(F.lit("on 2021-05-06"), F.col("known")).alias("m"), deid.counters_only(F.col("known")).alias("c")).first()
    assert again.m == "on [DATE_1]" and [(t.cat, t.n, t.raw) for t in again.c] == [("DATE", 1, None)]


WORST = {
    "title words": "Wordy " * 20_000,
    "street words": "12 Main " + "word " * 20_000,
    "hyphens": "Ab-Cd" * 20_000,
    "blanks": "Ab" + " " * 20_000 + "cd",
    "short dates": "on 3/14 and " * 5_000,
    "emails": "a@b.co " * 8_000,
    "digits": "1" * 100_000,
}


@pytest.mark.parametrize("shape", WORST)
def test_long_texts_pass_on_a_default_stack(spark, shape):
    df = spark.createDataFrame([(WORST[shape],)], "text STRING")
    parts = F.regexp_count("text", F.lit(deid.RESIDUAL)), F.regexp_count("text", F.lit(deid.edges(deid.STREET)))
    assert df.select(*parts).first() is not None
    assert vf.verified(df.withColumnRenamed("text", "redacted"), tokens=None).count() == 1


def test_signature_lines_without_end(spark):
    text = "Sincerely,\n" + "line\n" * 20_000 + "\nSincerely,\nend"
    cut, doubled = lt.duplicate_removed(F.col("text"))
    row = spark.createDataFrame([(text,)], "text STRING").select(cut.alias("cut"), doubled.alias("doubled")).first()
    assert row.doubled and row.cut == "Sincerely,\n" + ("line\n" * 20_000).rstrip()


def test_offsets_are_linear(spark):
    def seconds(n):
        df = spark.createDataFrame([("a@b.co " * n,)], "redacted STRING").repartition(1)
        start = time.time()
        leaks = vf.verified(df, tokens=None).select(F.size("leaks")).first()[0]
        assert leaks == n
        return time.time() - start

    seconds(10)
    assert seconds(8000) < 9 * max(seconds(1000), 0.5)


def test_every_turn_of_a_conversation_is_redacted_with_one_map(spark):
    from clearcase.plans.deid_queries import redacted_turns

    rows = [(1, 0, "hello there"), (1, 1, "write to kk.51@mail4.example.com"), (1, 2, "or to zz.99@mail5.example.com"),
            (1, 3, "again kk.51@mail4.example.com"), (None, 0, "write to kk.51@mail4.example.com")]
    found = {(r["conv_id"], r["turn"]): r for r in redacted_turns(spark.createDataFrame(rows, "conv_id long, turn int, text string")).collect()}
    assert len(found) == len(rows) and not any("@" in r["redacted"] for r in found.values())
    token = lambda r: re.findall(r"\[[A-Z_]+_\d+\]", r["redacted"])
    # An address has a number for each time it is met; the numbers go on from turn to turn.
    assert [token(found[1, k]) for k in range(4)] == [[], ["[EMAIL_1]"], ["[EMAIL_2]"], ["[EMAIL_3]"]]
    assert len(found[1, 3]["tokens"]) == 3 and len(found[None, 0]["tokens"]) == 1


def test_texts_of_a_case_equal_one_text_after_another(spark):
    """Numbers, contacts and names over any number of seams are those of redacting seam by seam with a carried token list."""
    from clearcase.operators import seams

    texts = [
        ["Patient: Noor Haddad, on 2021-05-06 and 3/4/2021", "Spouse: Lena Brandt. Haddad was seen 7/8/2022 by Dr. Chen.", "Lena Brandt wrote from a.b@c.example.com on 2021-05-06.",
         "Dr. Park and Sarah Chen, MD saw Noor in Denver, phone 212-555-0101.", "Acct #: ZX-1234. Her file is XJ3-889-21.", "Wife: Ada Moss. File XJ4-889-22, Lena Brandt, Hoboken and Denver."],
        ["no name yet 1/2/2020", "Patient name: Webb, Marcus", "Marcus Webb of Brooklyn, NY 11201", "mail x@y.example.org or z@y.example.org"],
        ["nothing at all"],
        [None, "", "Re: Grant Ferro\nDOB: 01/02/1960"],
    ]
    rows = [(c, k, t) for c, group in enumerate(texts) for k, t in enumerate(group)] + [(None, 0, "on 2020-02-02"), (None, 1, "on 2020-02-03")]
    found = {(r["c"], r["k"]): r for r in seams.shared(spark.createDataFrame(rows, "c long, k int, t string"), "c", ["k"], "t").collect()}
    assert len(found) == len(rows)
    step = spark.createDataFrame([(c, *(g + ["x"] * 6)[:6]) for c, g in enumerate(texts)], "c long, " + ", ".join(f"t{k} string" for k in range(6)))
    carried = None
    for k in range(6):
        step = settled(deid.deidentify(step, f"t{k}", tokens=carried, out=f"o{k}").withColumnRenamed("tokens", f"m{k}").drop("unclassified"))
        carried = f"m{k}"
    for r in step.collect():
        for k in range(len(texts[r["c"]])):
            one = found[r["c"], k]
            assert one["redacted"] == r[f"o{k}"], (r["c"], k)
            assert one["known"] == len(r[f"m{k}"]), (r["c"], k)
            own = {(t["token"]) for t in one["tokens"]}
            assert own <= {t["token"] for t in r[f"m{k}"]}
    assert "[DATE_2]" in found[None, 1]["redacted"]


def test_a_plan_does_not_follow_the_turns(spark):
    from clearcase.operators import seams

    rows = [(1, k, f"mail a{k}@b.example.com") for k in range(400)]
    done = seams.shared(spark.createDataFrame(rows, "conv_id long, turn int, text string"), "conv_id", ["turn"], "text").drop("tokens").withColumnRenamed("known", "tokens")
    assert {(r["turn"], r["redacted"], r["tokens"]) for r in done.collect()} == {(k, f"mail [EMAIL_{k + 1}]", k + 1) for k in range(400)}


def test_running_sums_are_linear(spark):
    from clearcase.functions import text as tx

    def seconds(n):
        df = spark.createDataFrame([("ab " * n,)], "t STRING").withColumn("p", F.split("t", " "))
        start = time.time()
        last = df.select(F.element_at(tx.with_running(F.col("p"), lambda x: F.length(x) + 1), -1)["sum"]).first()[0]
        assert last == 3 * n + 1
        return time.time() - start

    seconds(10)
    assert seconds(64_000) < 20 * max(seconds(4000), 0.2)
