"""Is every claim of a letter in its record, and every fact of a record in its chart?

Checks stay inside the row (arrays of claims), built up column by column so that
lambdas stay shallow; nothing is paired up across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearcase import fixed_values as fv
from clearcase.functions import text as tx
from clearcase.sources.tables import keyed

STRINGS = "array<string>"
VIOLATION = "struct<sentence:string,reason:string>"
LIMITATION_CLAIMS = [
    r"(?i)unable to ([a-z][a-z\s]{3,60})", r"(?i)difficulty (?:with )?([a-z][a-z\s]{3,60})",
    r"(?i)limited (?:ability|capacity) to ([a-z][a-z\s]{3,60})", r"(?i)cannot ([a-z][a-z\s]{3,60})",
    r"(?i)requires? (?:assistance|help) (?:with|from) ([a-z][a-z\s]{3,60})", r"(?i)relies? on ([a-z][a-z\s]{3,60})",
]
EVAL_CLAIMS = [r"(?i)unable to (\w[\w\s]{3,40})", r"(?i)difficulty (\w[\w\s]{3,40})", r"(?i)limited (?:ability|capacity) to (\w[\w\s]{3,40})", r"(?i)cannot (\w[\w\s]{3,40})"]
# What every match of a claim's pattern holds, in small letters: most sentences hold none of it and need no further look.
CLAIM_HINTS = ("unable to ", "difficulty ", "limited ", "cannot ", "require", "relie")
VERB_PREFIX = (
    r"^(?:to |use |walk |navigate |perform |climb |do |participate |engage |maintain |achieve |complete |carry |lift |stand |sit |bend |reach |grip "
    r"|ambulate |ascend |descend |with |basic |mobility |tasks |such as )+"
)


def none() -> Column:
    return F.array().cast(STRINGS)


def is_refusal(letter: Column | str) -> Column:
    return tx.col(letter).startswith(fv.REFUSAL_PREFIX)


def long_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 3))


def with_date_facts(df: DataFrame, text: str, out: str) -> DataFrame:
    """Canonical dates of every date shape found in ``text``."""
    found = df.withColumn(out, tx.find_all(text, *tx.RECORD_DATES))
    return found.withColumn(out, F.array_compact(F.transform(out, tx.canonical_date)))


def ungrounded_dates(df: DataFrame, letter: str, facts: str, letter_date: str) -> DataFrame:
    """Adds ``dates_missing``: dates and durations of the letter that the record does not hold in any format.

    A record's dates in ``fact_dates`` (``with_date_facts``) are taken as they are, so that they are found once for a record
    and not once for each of its drafts.
    """
    df = df.withColumnRenamed("fact_dates", "_fact_dates") if "fact_dates" in df.columns else with_date_facts(df, facts, "_fact_dates")
    df = df.withColumn("_claims", tx.find_all(letter, *tx.LETTER_DATES, tx.DURATION))
    loose = F.filter("_claims", lambda v: (v != F.col(letter_date)) & ~tx.contains(F.col(facts), v))
    df = df.withColumn("_claims", F.transform(loose, lambda v: F.struct(v.alias("v"), tx.canonical_date(v).alias("d"))))
    missing = F.filter("_claims", lambda x: ~F.coalesce(F.array_contains("_fact_dates", x["d"]), F.lit(False)))
    return df.withColumn("dates_missing", F.transform(missing, lambda x: x["v"])).drop("_claims", "_fact_dates")


def terms_missing(letter: Column, facts: Column) -> Column:
    """High-risk terms of the letter that the record does not use. Both texts are lower-cased once, not once a term."""
    terms = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(t.lower()).alias("low")) for t in fv.HIGH_RISK_TERMS])
    both = F.struct(F.lower(letter).alias("l"), F.lower(facts).alias("f"))
    return tx.let(both, lambda x: F.transform(F.filter(terms, lambda t: tx.contains(x["l"], t["low"]) & ~tx.contains(x["f"], t["low"])), lambda t: t["t"]))


def doses_missing(letter: Column, facts: Column) -> Column:
    return F.filter(tx.find_all(letter, tx.DOSAGE), lambda v: ~tx.contains(facts, v))


def claims_of(sentences: Column, patterns: list[str]) -> Column:
    """(text, claim, sentence) for every limitation phrase; the daily-living closing sentence is none."""
    hints = CLAIM_HINTS[: len(patterns)]
    lowered = F.transform(sentences, lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))
    kept = F.filter(lowered, lambda x: tx.holds(x["low"], *hints) & ~tx.holds(x["low"], "activities of daily living"))
    none_ = F.array().cast("array<struct<m:string,claim:string,s:string>>")

    def of(x: Column) -> Column:
        # The claim is taken from the match, which is short, and not from the sentence again.
        each = [F.when(tx.holds(x["low"], hint), F.transform(F.regexp_extract_all(x["s"], F.lit(p), F.lit(0)), lambda m: F.struct(
            m.alias("m"), F.lower(tx.strip(F.regexp_extract(m, p, 1))).alias("claim"), x["s"].alias("s")))).otherwise(none_) for p, hint in zip(patterns, hints)]
        return F.concat(*each)

    return F.flatten(F.transform(kept, of))


def ungrounded_limitations(df: DataFrame, letter: str, limitations: str) -> DataFrame:
    """Adds ``limitations_missing``: claims that no listed limitation covers."""
    df = df.withColumn("_claims", claims_of(tx.sentences(letter), LIMITATION_CLAIMS))
    allowed = F.transform(limitations, lambda a: F.struct(F.lower(a).alias("a"), long_words(F.lower(a)).alias("w")))

    def covered(x: Column, allowed: Column) -> Column:
        return F.exists(allowed, lambda a: tx.contains(a["a"], F.left(x["claim"], F.lit(15))) | tx.contains(x["claim"], F.left(a["a"], F.lit(15)))
                        | (F.size(F.array_intersect(long_words(x["claim"]), a["w"])) >= 2))

    # Made once a letter: as a column it would be written out in the lambda and made for every claim.
    bad = F.when(F.size("_claims") == 0, F.col("_claims")).otherwise(tx.let(allowed, lambda al: F.filter("_claims", lambda x: ~covered(x, al))))
    said = F.transform(bad, lambda x: F.concat(F.lit('"'), tx.strip(x["m"]), F.lit('"  (sentence: '), x["s"], F.lit(")")))
    return df.withColumn("limitations_missing", F.array_distinct(said)).drop("_claims")


def source_lock(df: DataFrame, letter: str = "letter", facts: str = "facts", letter_date: str = "letter_date") -> DataFrame:
    """Adds ``violations``; a refusal is no letter and has none."""
    df = ungrounded_limitations(ungrounded_dates(df, letter, facts, letter_date), letter, "functional_limitations")
    df = df.withColumns({"_terms": terms_missing(F.col(letter), F.col(facts)), "_doses": doses_missing(F.col(letter), F.col(facts))})
    said = lambda what, c: F.transform(c, lambda v: F.concat(F.lit(f'Ungrounded {what} in letter: "'), v, F.lit('"')))
    every = F.concat(said("date/duration", "dates_missing"), said("high-risk term", "_terms"), said("dosage", "_doses"), F.col("limitations_missing"))
    return df.withColumn("violations", F.when(is_refusal(letter), none()).otherwise(every)).drop("dates_missing", "limitations_missing", "_terms", "_doses")


def has_pending_imaging(chart: Column | str) -> Column:
    """Some sentence names a study and says it is still to come."""
    parts = F.split(F.lower(tx.col(chart)), r"(?<=[.!?])\s+")
    holds = lambda s, words: s.rlike("|".join(words))
    return F.exists(parts, lambda s: holds(s, fv.IMAGING_TERMS) & holds(s, fv.PENDING_PHRASES))


def record_against_chart(df: DataFrame, chart: str = "chart_text") -> DataFrame:
    """Adds ``discrepancies``: birth date, codes and treatment dates the chart does not hold; imaging still pending."""
    text = F.col(chart)
    df = with_date_facts(df, chart, "_chart_dates")
    dob = F.col("date_of_birth")
    absent = lambda v: ~tx.contains(text, v) & ~F.coalesce(F.array_contains("_chart_dates", tx.canonical_date(v)), F.lit(False))
    dated = F.filter("treatments", lambda t: (t["dates"] != "") & (t["dates"] != "Not documented"))
    df = df.withColumn("_claims", F.flatten(F.transform(dated, lambda t: F.transform(tx.find_all(t["dates"], *tx.RECORD_DATES), lambda d: F.struct(d.alias("d"), t["treatment"].alias("t"))))))
    return df.withColumn("discrepancies", F.concat(
        F.array_compact(F.array(F.when(dob.isNotNull() & ~dob.rlike(r"^\[[A-Z_]+\]$") & absent(dob), F.concat(F.lit("date of birth: "), dob)))),
        F.transform(F.filter("diagnosis_codes", lambda c: (c != "") & ~tx.contains(F.lower(text), F.lower(c))), lambda c: F.concat(F.lit("diagnosis code: "), c)),
        F.transform(F.filter("_claims", lambda x: absent(x["d"])), lambda x: F.concat(F.lit("treatment date: "), x["d"], F.lit(" of "), x["t"])),
        F.when((F.col("imaging_status") == "completed") & has_pending_imaging(chart), F.array(F.lit("imaging may be pending"))).otherwise(none()),
    )).drop("_claims", "_chart_dates")


def with_extraction_warnings(checked: DataFrame, qa: DataFrame, key: str = "case_id") -> DataFrame:
    """Adds ``extraction_warnings``: the ``discrepancies`` of each record, then what a model's own check said of it.

    ``qa`` is (key, seq, warning); its rows are brought together per record in the order of ``seq``. Neither list blocks
    anything, and a record that only one of them names has that one's.
    """
    said = qa.where(F.col("warning").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "warning"))).alias("_qa"))
    both = F.concat("discrepancies", F.coalesce(F.transform("_qa", lambda x: x["warning"]), none()))
    return checked.join(keyed(said), key, "left").withColumn("extraction_warnings", both).drop("_qa")


# ---- evaluation checks --------------------------------------------------------

def canonical_limitation(c: Column) -> Column:
    synonyms = F.create_map(*[F.lit(x) for kv in fv.LIMITATION_SYNONYMS.items() for x in kv])
    words = F.split(tx.strip(F.regexp_replace(c, VERB_PREFIX, "")), r"\s+")
    return F.array_join(F.transform(words, lambda w: F.coalesce(synonyms[w], w)), " ")


def evaluation_violations(df: DataFrame, letter: str = "letter") -> DataFrame:
    """Adds ``eval_violations`` (sentence, reason), one per sentence start."""
    df = df.withColumn("_sents", tx.sentences(letter, 16))
    df = df.withColumn("_first", F.filter(claims_of(F.col("_sents"), EVAL_CLAIMS), lambda x: x["claim"] != ""))
    prefix = r"(?i)^(cannot|unable to|difficulty|limited ability to)\s*"
    content = lambda c: F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 3)
    allowed = F.transform("functional_limitations", lambda a: canonical_limitation(F.regexp_replace(F.lower(a), prefix, "")))

    def covered(x: Column, allowed: Column) -> Column:
        def by(a: Column) -> Column:
            shared = F.size(F.filter(a["own"], lambda w: F.array_contains(x["words"], w)))
            return (tx.contains(a["a"], F.left(x["c"], F.lit(12))) | tx.contains(x["c"], F.left(a["a"], F.lit(12))) | (shared >= 2)
                    | ((shared >= 1) & (F.size(a["own"]) <= 3)))
        return F.exists(allowed, by)

    def unlisted(allowed: Column) -> Column:
        claims = F.transform("_first", lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"), canonical_limitation(x["claim"]).alias("c")))
        claims = F.transform(claims, lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"), x["c"].alias("c"), content(x["c"]).alias("words")))
        return F.transform(F.filter(claims, lambda x: ~covered(x, allowed)), lambda x: F.struct(
            x["s"].alias("sentence"), F.concat(F.lit("Limitation not listed: "), tx.strip(x["m"])).alias("reason")).cast(VIOLATION))

    # Texts that a lambda reads for every word or claim are made once a letter; as columns they would be written out in the lambda.
    low = F.struct(F.lower(letter).alias("letter"), F.transform("_sents", lambda s: F.struct(s.alias("s"), F.lower(s).alias("low"))).alias("sents"), F.lower(F.coalesce("surgical_approach", F.lit(""))).alias("approach"),
                   F.lower(F.array_join(F.transform("treatments", lambda t: t["treatment"]), ",")).alias("named"))

    def words(low: Column, listed: list[str], absent: Column | None, reason: str) -> Column:
        hit = F.filter(F.array(*[F.lit(w) for w in listed]), lambda w: tx.contains(low["letter"], w) & (~tx.contains(absent, w) if absent is not None else F.lit(True)))
        return F.transform(hit, lambda w: F.struct(
            F.coalesce(F.get(F.filter(low["sents"], lambda s: tx.contains(s["low"], w)), F.lit(0))["s"], F.concat(F.lit("(contains: "), w, F.lit(")"))).alias("sentence"),
            F.concat(F.lit(reason + ": "), w).alias("reason")).cast(VIOLATION))

    empty = F.array().cast(f"array<{VIOLATION}>")
    df = df.withColumn("_all", tx.let(low, lambda x: F.concat(
        words(x, fv.IMPLANT_WORDS, x["approach"], "Implant or fixation not in the approach"),
        words(x, fv.INJECTION_GUIDANCE_WORDS, x["named"], "Injection technique not documented"),
        words(x, fv.FUTURE_CARE_WORDS, None, "Future care not in the source"),
        F.when((F.size("functional_limitations") > 0) & (F.size("_first") > 0), tx.let(
            F.transform(allowed, lambda a: F.struct(a.alias("a"), content(a).alias("own"))), unlisted)).otherwise(empty),
        F.when(F.col("imaging").isNull(), words(x, fv.IMAGING_WORDS_WHEN_NULL, None, "Imaging named without findings")).otherwise(empty))))
    df = df.withColumn("_keys", F.transform("_all", lambda v: F.left(v["sentence"], F.lit(80))))
    unique = F.filter("_all", lambda v, i: F.array_position("_keys", F.left(v["sentence"], F.lit(80))) == i + 1)
    return df.withColumn("eval_violations", F.when(tx.contains(F.col(letter), F.lit(fv.REFUSAL_PREFIX)), empty).otherwise(unique)).drop("_sents", "_first", "_all", "_keys")


def combined_violations(df: DataFrame) -> DataFrame:
    """Adds ``all_violations``: evaluation checks, then source lock, first per reason."""
    locked = F.transform("violations", lambda r: F.struct(F.lit("").alias("sentence"), r.alias("reason")).cast(VIOLATION))
    df = df.withColumn("_all", F.concat("eval_violations", locked))
    df = df.withColumn("_keys", F.transform("_all", lambda v: v["reason"]))
    return df.withColumn("all_violations", F.filter("_all", lambda v, i: F.array_position("_keys", v["reason"]) == i + 1)).drop("_all", "_keys")
