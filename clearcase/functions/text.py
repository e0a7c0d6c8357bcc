"""Scalar text functions as Column expressions (JVM side, no UDF but NFKC)."""

from __future__ import annotations

import functools
import operator
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clearcase import fixed_values as fv

WHITESPACE = " \t\n\r\f\x0b\u00a0"
# Both edges of a word by ASCII rules; Java's own \b follows Unicode letters.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
BEGIN, END = r"(?<!\w)", r"(?!\w)"
MONTH = "(?:" + "|".join(fv.MONTH_NAMES) + ")"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def nonblank(c: Column | str) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def extract(c: Column | str, pattern: str, group: int = 0) -> Column:
    """First match, null instead of the empty string when there is none."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def contains(c: Column, needle: Column) -> Column:
    # Looks at first bytes; ``instr`` compares whole needles at every character and was a third of a letter's checks.
    return F.contains(c, needle)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def holds(c: Column, *needles: str) -> Column:
    """Whether one of ``needles`` is in the text: far cheaper than a search by a pattern that needs one of them."""
    return functools.reduce(operator.or_, [contains(c, F.lit(n)) for n in needles])


def replaced(c: Column, needles: tuple[str, ...], pattern: str, replacement: str) -> Column:
    """``pattern`` replaced; only a text that holds one of ``needles``, as every match does, is searched for it."""
    return let(c, lambda t: F.when(holds(t, *needles), F.regexp_replace(t, pattern, replacement)).otherwise(t))


def each(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per element that is not null.

    A plain ``explode`` makes Spark infer a filter on the array's size, push it below and so work the array out twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


# ---- normal forms -------------------------------------------------------

@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


ZERO_WIDTH = "[\\u200B-\\u200F\\u2060\\uFEFF\\u00AD]"
ZERO_WIDTH_AND_BIDI = "[\\u200B-\\u200F\\u202A-\\u202E\\u2060\\uFEFF\\u00AD\\uFE00-\\uFE0F]"
_FOLD_FROM = "\u2018\u2019\u201a\u201c\u201d\u201e\u2012\u2013\u2014\u2212\u00a0\u202f"
_FOLD_TO = "'" * 6 + "-" * 4 + " " * 2
# ASCII and composed Latin-1 letters are fixed points of NFKC.
MAY_CHANGE = "[^\\x00-\\x7F\\u00C0-\\u00FF]"


def fold_punctuation(c: Column | str, invisible: str = ZERO_WIDTH) -> Column:
    """Quotes to ', dashes to -, hard spaces to blank, invisible characters gone."""
    return F.translate(F.regexp_replace(col(c), invisible, ""), _FOLD_FROM, _FOLD_TO)


def normalized(c: Column | str, invisible: str = ZERO_WIDTH) -> Column:
    """NFKC and folded punctuation; only text that NFKC may change travels to Python."""
    text = col(c)
    composed = F.coalesce(_nfkc(F.when(text.rlike(MAY_CHANGE), text)), text)
    return fold_punctuation(composed, invisible)


def json_text(c: Column | str) -> Column:
    """A text as the body of a JSON string."""
    text = F.to_json(F.struct(col(c).alias("v")))
    return F.substring(text, F.lit(7), F.length(text) - 8)


# ---- sentences and sections --------------------------------------------

def sentences(c: Column | str, min_chars: int = 1) -> Column:
    # Lines joined by one blank; split by a single character, which needs no pattern.
    flat = F.array_join(F.filter(F.split(col(c), "\n"), lambda x: x != ""), " ")
    parts = F.transform(F.split(flat, r"\s(?<=[.!?]\s)\s*"), strip)  # a blank first, then what it stands behind
    return F.filter(parts, lambda s: F.length(s) >= min_chars)


def section(c: Column | str, header: str, *ends: str) -> Column:
    """Text from ``header`` up to the nearest following end header."""
    text = col(c)
    start = F.instr(text, F.lit(header))
    found = [F.call_function("locate", F.lit(e), text, start + len(header)) for e in ends]
    end_of_text = F.length(text) + 1
    stop = F.least(*[F.when(at > 0, at) for at in found], end_of_text) if found else end_of_text
    return F.when(start > 0, strip(F.substring(text, start, stop - start))).otherwise("")


# ---- durations ----------------------------------------------------------

def payer_weeks(c: Column | str) -> Column:
    """Weeks in a payer's or a treatment's duration text, 0 when it names none.

    The unit must follow the number, so of "12 or 24 weeks" 24 counts.
    """
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*(week|month)"
    n = extract(c, pattern, 1).cast("double")
    factor = F.when(F.lower(F.regexp_extract(col(c), pattern, 2)) == "month", 4.33).otherwise(1.0)
    return F.coalesce(F.floor(n * factor + 0.5), F.lit(0)).cast("bigint")


def symptom_weeks(c: Column | str) -> Column:
    """Weeks of symptoms, unrounded; null without a number and unit."""
    pattern = r"(?i)(\d+(?:\.\d+)?)\+?\s*(day|week|month|year)"
    n = extract(c, pattern, 1).cast("double")
    unit = F.lower(F.regexp_extract(col(c), pattern, 2))
    return F.when(unit == "day", n / 7).when(unit == "week", n).when(unit == "month", n * 4.33).when(unit == "year", n * 52)


def has_duration(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"(?i)\d+(?:\.\d+)?\+?\s*(day|week|month|year|session|visit)s?(?!\w)"), F.lit(False))


# ---- dates --------------------------------------------------------------

def month_number(name: Column) -> Column:
    pairs = [x for k, v in fv.MONTH_NUMBERS.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[F.lower(name)]


def canonical_date(c: Column | str) -> Column:
    """YYYY-MM or YYYY-MM-DD of "June 15, 2024", "June 2024", "6/15/24" and "06/2024"; else null."""
    long, short = r"^([A-Za-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})$", r"^([A-Za-z]+)\.?\s+(\d{4})$"
    full, month_year = r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})$", r"^(\d{1,2})/(\d{4})$"
    part = F.regexp_extract
    two = lambda x: F.lpad(x, 2, "0")

    def named(s: Column) -> Column:
        return let(month_number(F.regexp_extract(s, r"^[A-Za-z]+", 0)), lambda m: F.when(m.isNotNull(), F.coalesce(
            F.when(s.rlike(long), F.concat_ws("-", part(s, long, 3), m, two(part(s, long, 2)))),
            F.when(s.rlike(short), F.concat_ws("-", part(s, short, 2), m)))))

    def numeric(s: Column) -> Column:
        year = let(part(s, full, 3), lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y))
        return F.when(s.rlike(full), F.concat_ws("-", year, two(part(s, full, 1)), two(part(s, full, 2)))).when(
            s.rlike(month_year), F.concat_ws("-", part(s, month_year, 2), two(part(s, month_year, 1))))

    return let(strip(c), lambda s: F.when(s.rlike(r"^\d"), numeric(s)).otherwise(named(s)))


# The first character of a match is looked for before what stands in front of it: a look around costs far more, at every position.
_NUMBER = r"\d(?<!\w\d)"
_MONTHS = [m for m in fv.MONTH_NAMES if m != "Sept"]
_BEGINNINGS = sorted({m[:3] for m in _MONTHS})
_ANY_MONTH = "".join("[" + "".join(sorted({b[k].upper() for b in _BEGINNINGS})) + "]" for k in range(3)) + r"(?<!\w...)(?:" + "|".join(
    f"(?<={b})(?:{'|'.join(m[3:] for m in _MONTHS if m[:3] == b)})" for b in _BEGINNINGS) + ")"
ISO = _NUMBER + r"\d{3}-\d{2}-\d{2}" + END
NUMERIC_DATE = _NUMBER + r"\d?[/\-]\d{1,2}[/\-]\d{2,4}" + END
MONTH_SLASH_YEAR = _NUMBER + r"\d?/\d{4}" + END
LONG_DATE = "(?i)" + _ANY_MONTH + r"\.?\s+\d{1,2},?\s+\d{4}" + END
MONTH_YEAR = "(?i)" + _ANY_MONTH + r"\.?\s+\d{4}" + END
LATE_EARLY = r"(?i)[le]a(?<!\w.a)(?:(?<=la)te|(?<=ea)rly)\s+\d{4}" + END
DURATION = "(?i)" + _NUMBER + r"\d*\s?(?:day|week|month|year)s?" + END
DOSAGE = "(?i)" + _NUMBER + r"\d*\s?mg" + END
LETTER_DATES = [ISO, NUMERIC_DATE, LONG_DATE, MONTH_YEAR, LATE_EARLY]
RECORD_DATES = [ISO, NUMERIC_DATE, MONTH_SLASH_YEAR, LONG_DATE, MONTH_YEAR]


#: What every match of a pattern holds one of; a text without it is not searched.
HINTS = {ISO: ("-",), NUMERIC_DATE: ("/", "-"), MONTH_SLASH_YEAR: ("/",)}


def find_all(c: Column | str, *patterns: str) -> Column:
    none = F.array().cast("array<string>")
    every = lambda p: F.regexp_extract_all(col(c), F.lit(p), F.lit(0))
    found = [F.when(holds(col(c), *HINTS[p]), every(p)).otherwise(none) if p in HINTS else every(p) for p in patterns]
    return F.concat(*found) if len(found) > 1 else found[0]


# ---- names, hashes, slugs ----------------------------------------------

def keyed_hash(c: Column | str, key: str) -> Column:
    """HMAC-SHA256 of the trimmed lower-case text under ``key``; refuses an empty key."""
    if not key:
        raise ValueError("a hashing key must be configured to hash names")
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    pad = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in pad), bytes(b ^ 0x5C for b in pad)
    message = F.encode(F.lower(strip(c)), "UTF-8")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def short_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 12)


def packet_file_name(patient: Column | str, cpt: Column | str) -> Column:
    safe = F.lower(F.regexp_replace(F.regexp_replace(col(patient), "(?i)[^a-z0-9]+", "-"), "^-|-$", ""))
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("patient")), F.lit("-pa-packet-cpt-"), col(cpt), F.lit(".docx"))


def anchor_slug(c: Column | str) -> Column:
    return F.substring(F.regexp_replace(col(c), "(?i)[^a-z0-9]", ""), 1, 24)


def signature_name(c: Column | str) -> Column:
    bare = strip(F.regexp_replace(col(c), r"(?i)^Dr\.\s*", ""))
    doctor = bare.rlike("(?i)" + EDGE + r"M\.?D\.?" + EDGE + "|" + EDGE + r"D\.?O\.?" + EDGE)
    return F.when(doctor, bare).otherwise(F.concat(bare, F.lit(", MD")))


def long_date(c: Column | str) -> Column:
    return F.date_format(c, "MMMM d, yyyy")


def surname_key(c: Column | str) -> Column:
    """Key that joins "Sarah Chen, MD" and "Dr. Chen"."""
    bare = F.regexp_replace(F.regexp_replace(col(c), r"(?i)^Dr\.?\s+", ""), r"(?i),?\s+(MD|D\.?O\.?|PA-C|NP|RN|DPM)\.?$", "")
    return F.element_at(F.split(F.lower(strip(bare)), r"\s+"), -1)


def name_parts(c: Column | str) -> Column:
    """first, middle, last, suffix of "First M. Last Jr." or "Last, First M."."""
    suffix = r"(?i),?\s+((?:Jr|Sr|II|III|IV)\.?)$"
    clean = strip(F.regexp_replace(col(c), r"\s+", " "))
    bare = strip(F.regexp_replace(clean, suffix, ""))
    given = F.filter(F.split(F.coalesce(F.get(F.split(bare, ","), F.lit(1)), F.lit("")), " "), lambda x: x != "")
    words = F.filter(F.split(bare, " "), lambda x: x != "")
    comma = contains(bare, F.lit(","))
    n = F.size(words)
    middle_of = lambda a, start, count: F.when(count > 0, F.array_join(F.slice(a, start, F.greatest(count, F.lit(0))), " "))
    return F.struct(
        F.when(comma, F.get(given, F.lit(0))).when(n > 1, F.get(words, F.lit(0))).alias("first"),
        F.when(comma, middle_of(given, 2, F.size(given) - 1)).otherwise(middle_of(words, 2, n - 2)).alias("middle"),
        F.when(comma, strip(F.get(F.split(bare, ","), F.lit(0)))).otherwise(F.get(words, n - 1)).alias("last"),
        extract(clean, suffix, 1).alias("suffix"),
    )


def name_variants(parts: Column) -> Column:
    """Every form a name is swept in, longest first."""
    first, middle, last = parts["first"], parts["middle"], parts["last"]
    tail = F.coalesce(F.concat(F.lit(" "), F.regexp_replace(parts["suffix"], r"\.$", "")), F.lit(""))
    has_first = first.isNotNull()
    honor = [F.when(has_first, F.concat(F.lit(h + ". "), last)) for h in ("Mr", "Ms", "Mrs", "Mx")]
    forms = F.array(
        F.when(has_first, F.concat(first, F.lit(" "), last, tail)),
        F.when(has_first, F.concat(first, F.lit(" "), middle, F.lit(" "), last, tail)),
        F.when(has_first, F.concat(last, F.lit(", "), first, tail)),
        F.when(has_first, F.concat(last, F.lit(", "), first, F.lit(" "), middle, tail)),
        *honor,
        last,
        F.when(has_first & (F.length(first) >= 3) & ~F.lower(first).isin(fv.FIRST_NAME_STOPLIST), first),
    )
    halves = F.filter(F.split(last, "-"), lambda h: F.length(h) > 1)
    all_forms = F.array_distinct(F.array_compact(F.concat(forms, F.coalesce(halves, F.array().cast("array<string>")))))
    keyed = F.transform(all_forms, lambda v, i: F.struct((-F.length(v)).alias("k"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def literal(c: Column) -> Column:
    """A text as a regular expression that matches only itself."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def with_running(items: Column, amount: Callable[[Column], Column]) -> Column:
    """(item, sum) for every item of an array: the amounts up to and including it.

    Added up in blocks of about the root of the number of items: an array that grows is copied for each item, so no
    array may grow beyond that.
    """
    ints = "array<int>"

    def within(block: Column, base: Column) -> Column:
        return F.aggregate(block, F.array().cast(ints), lambda sums, x: F.array_append(sums, F.coalesce(F.get(sums, F.size(sums) - 1), base, F.lit(0)) + amount(x)))

    def summed(whole: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(whole))), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(whole) - 1, F.lit(0)) / width).cast("int")), lambda k: F.slice(whole, k * width + 1, width))
        last = lambda done: F.get(F.get(done, F.size(done) - 1), F.size(F.get(done, F.size(done) - 1)) - 1)
        sums = F.flatten(F.aggregate(blocks, F.array().cast(f"array<{ints}>"), lambda done, block: F.array_append(done, within(block, last(done)))))
        return F.zip_with(whole, sums, lambda i, n: F.struct(i.alias("item"), n.alias("sum")))

    return F.when(items.isNotNull(), let(items, summed))
