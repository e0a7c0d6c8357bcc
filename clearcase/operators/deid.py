"""Corpus de-identification: ordered passes over a text column, all in Catalyst.

The state of a row is two columns: the text so far and its token list.  A pass is
three flat projections (matches, new tokens, text joined again from the parts
between the matches); a cheap hint pattern decides whether a row is touched at
all.  Lambdas are kept shallow on purpose: type resolution of nested ones grows
with the power of their depth.  No UDF, no shuffle; state never leaves its row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcase import fixed_values as fv
from clearcase.functions import leaves
from clearcase.functions import text as tx
from clearcase.operators import vocabulary
from clearcase.sources.tables import settled

TOKEN = "struct<cat:string,n:int,token:string,raw:string,key:string>"
TOKENS = f"array<{TOKEN}>"

def default_allowlist() -> list[str]:
    """The seed plus side-and-joint phrases; sites pass their own vocabulary."""
    return fv.ALLOWLIST_SEED + [f"{s} {j}" for s in fv.SIDES for j in fv.JOINTS]


def edges(pattern: str) -> str:
    """ASCII word edges for every \\b, whatever letters surround the match."""
    return pattern.replace(r"\b", tx.EDGE)


def led(first: str, pattern: str) -> str:
    """``pattern``, whose matches begin with ``first``: that is looked at before edges and labels, at nearly every position alone."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flag}(?={first}){pattern[len(flag):]}"


def after(chars: int) -> str:
    return rf"(?=([\s\S]{{0,{chars}}}))"


# ---- one pass -----------------------------------------------------------------

def _no_tokens() -> Column:
    return F.array().cast(TOKENS)


def last_number(toks: Column, cat: str) -> Column:
    mine = F.filter(toks, lambda t: t["cat"] == cat)
    return F.coalesce(F.array_max(F.transform(mine, lambda t: t["n"])), F.lit(0))


def _entry(cat: Column, n: Column, token: Column, raw: Column, key: Column) -> Column:
    return F.struct(cat.alias("cat"), n.cast("int").alias("n"), token.alias("token"), tx.strip(raw).alias("raw"), key.alias("key")).cast(TOKEN)


@dataclass(frozen=True)
class Pass:
    """Pattern, how a match becomes a token, and how the token is written back.

    ``cat`` numbers tokens within a category: each match anew, or one number per
    distinct ``key``.  Without ``cat``, ``key`` is the whole token and the first
    value it stood for is kept.
    """

    name: str
    pattern: str
    hint: str
    cat: str | None
    raw: Callable[[Column], Column]
    key: Callable[[Column], Column] | None = None
    render: Callable[[Column, Column], Column] = lambda token, m: token
    keep: Callable[[Column], Column] | None = None  # False leaves the match as it is
    order: Callable[[Column], Column] | None = None  # numbering order; else order of appearance
    groups: int = 0
    context: int = 0  # characters before a match that ``keep`` looks at, as ``ahead``


def _ahead(i: Column, chars: int) -> Column:
    """The last ``chars`` characters before match ``i``.

    Every earlier match has a character at least, so no more than ``chars`` parts and matches before it are read.
    """
    first = F.greatest(i - chars, F.lit(0))
    pieces = F.zip_with(F.slice("_cut", first + 1, i - first), F.slice("_whole", first + 1, i - first), lambda a, b: F.concat(a, b))
    return F.right(F.concat(F.array_join(pieces, ""), F.get("_cut", i)), F.lit(chars))


def run_pass(df: DataFrame, p: Pass) -> DataFrame:
    text, toks, hits = F.col("_text"), F.col("_toks"), F.col("_hits")
    pattern = F.lit(p.pattern)
    arrays = [F.regexp_extract_all(text, pattern, F.lit(g)).alias(f"g{g}") for g in range(p.groups + 1)]

    # A text is searched once before its matches are taken apart, which searches it again for every group.
    touched = text.rlike(p.hint) & text.rlike(p.pattern)
    if p.context:
        # Read from the cut text: a capturing lookbehind costs its width at every position.
        df = df.withColumns({"_cut": F.when(touched, F.split(text, p.pattern, -1)), "_whole": F.when(touched, arrays[0])})

    def hit(m: Column, i: Column) -> Column:
        own = [m[f"g{g}"].alias(f"g{g}") for g in range(p.groups + 1)] + ([m["ahead"].alias("ahead")] if p.context else [])
        return F.struct(*own, (F.coalesce(p.keep(m), F.lit(False)) if p.keep else F.lit(True)).alias("keep"),
                        p.raw(m).alias("raw"), (p.key(m) if p.key else F.lit(None).cast("string")).alias("key"))

    matches = F.arrays_zip(*arrays)
    if p.context:
        matches = F.transform(matches, lambda m, i: m.withField("ahead", _ahead(i, p.context)))
    found = F.when(touched, F.transform(matches, hit))
    if p.keep and p.key is None:
        found = F.transform(tx.with_running(found, lambda h: h["keep"].cast("int")), lambda x: x["item"].withField("rank", x["sum"]))
    df = df.withColumns({"_hits": found, "_last": last_number(toks, p.cat) if p.cat else F.lit(0)})
    any_hit = F.coalesce(F.size(hits) > 0, F.lit(False))
    kept = F.filter(hits, lambda h: h["keep"])
    last, new_keys = F.col("_last"), F.col("_new")

    if p.key is None:
        def token(h: Column, i: Column) -> Column:
            rank = h["rank"] if p.keep else i + 1
            return F.concat(F.lit(f"[{p.cat}_"), (last + rank).cast("string"), F.lit("]"))

        def minted(h: Column, i: Column) -> Column:
            n = last + i + 1
            return _entry(F.lit(p.cat), n, F.concat(F.lit(f"[{p.cat}_"), n.cast("string"), F.lit("]")), h["raw"], F.lit(None).cast("string"))

        added = F.transform(kept, minted)
    else:
        keyed = F.transform(kept, lambda h: h["key"])
        if p.order:
            ranked = F.array_sort(F.array_distinct(F.transform(kept, lambda h: F.struct(p.order(h).alias("o"), h["key"].alias("key")))))
            keyed = F.transform(ranked, lambda x: x["key"])
        stored = F.transform(F.filter(toks, lambda t: t["cat"] == p.cat), lambda t: t["key"]) if p.cat else F.transform(toks, lambda t: t["token"])
        df = df.withColumn("_new", F.when(any_hit, F.array_except(F.array_distinct(keyed), stored)))

        def number_of(key: Column) -> Column:
            known = F.filter(toks, lambda t: (t["cat"] == p.cat) & (t["key"] == key))
            return F.coalesce(F.get(known, F.lit(0))["n"], last + F.array_position(new_keys, key))

        def token(h: Column, i: Column) -> Column:
            return F.concat(F.lit(f"[{p.cat}_"), number_of(h["key"]).cast("string"), F.lit("]")) if p.cat else h["key"]

        def minted(key: Column, i: Column) -> Column:
            raw = F.get(F.filter(hits, lambda h: h["keep"] & (h["key"] == key)), F.lit(0))["raw"]
            if not p.cat:
                return _entry(F.regexp_replace(key, r"[\[\]]", ""), F.lit(1), key, raw, F.lit(None).cast("string"))
            n = last + i + 1
            return _entry(F.lit(p.cat), n, F.concat(F.lit(f"[{p.cat}_"), n.cast("string"), F.lit("]")), raw, key)

        added = F.transform(new_keys, minted)

    def written(h: Column, i: Column) -> Column:
        done = p.render(token(h, i), h)
        return F.when(h["keep"], done).otherwise(h["g0"]) if p.keep else done

    out = F.array_append(F.transform(hits, written), F.lit(""))
    joined = F.array_join(F.zip_with(F.split(text, p.pattern, -1), out, lambda a, b: F.concat(a, b)), "")
    return df.withColumns({
        "_text": F.when(any_hit, joined).otherwise(text),
        "_toks": F.when(any_hit, F.concat(toks, added)).otherwise(toks),
    })


# ---- the passes in order -------------------------------------------------------
# Patterns that decide what counts as an identifier.

_START, _NO_LETTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z])"
_MONTH = tx.MONTH
_CREDENTIAL = r"(MD|D\.?O\.?|PA-C|NP|RN|DPM)"
_NAME_STOP = r"(?!(?:DOB|MRN|SSN|AGE|SEX|DATE|POLICY|PHONE|FAX|ADDRESS|INSURANCE|RACE|GENDER|MD|DO)\b)"
_NAME_WORDS = rf"[A-Z][A-Za-z'\-]+(?:,)?(?:[ \t]+{_NAME_STOP}[A-Z][A-Za-z'.\-]*){{0,3}}"
_SUFFIX = r"(?:Jr|Sr|II|III|IV)\.?"
_ID = r"([A-Z0-9][A-Z0-9\-]{2,})"
_DATE_WORDS = r"on|since|dated|seen|visit(?:ed)?|injury|surgery|MRI|x-?ray|follow-?up|appt\.?|appointment"
DATE_CONTEXT = edges(rf"(?i)(?:\b(?:{_DATE_WORDS})\b|\bappt\.)\s*[:\-]?\s*\z")
CLINICAL_CONTEXT = edges(r"(?i)\b(ROM|BP|strength|acuity|scale|motor|pulses|reflexes|pain)\b")
CODE_CONTEXT = edges(r"(?i)\b(CPT|ICD|HCPCS|DX|code)\b")
LOCATION_WORDS = (
    r"relocated\s+(?:from|to)|moved\s+(?:from|to)|resides?\s+in|lives?\s+in|living\s+in|travel(?:ed|led)\s+(?:from|to)|"
    r"referred\s+from|transferred\s+(?:from|to)|commutes\s+from|returned\s+(?:from|to)|originally\s+from|hails\s+from|based\s+in|located\s+in"
)
# Group loops recurse in the regex engine, so words are runs of characters: blanks and letters up to the last street word.
STREET = (
    r"\b\d{1,5}\s+[A-Z][a-zA-Z]+\s[A-Za-z\s]*(?<=\s)(?:Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Ln|Way|Court|Ct|Place|Pl)\.?"
    r"(?:\s+(?:Suite|Ste|Apt|Unit)\.?\s*[A-Z0-9]+)?\b"
)
FACILITY = r"\b[A-Z][a-zA-Z&'\- ]*(?:Hospital|Clinic|Medical Center|Health System|Surgery Center|Health Center|Orthopedic(?:s| Center)?)\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
URL = r"\bhttps?://[^\s\"'<>)\]]+"
PHONE = r"\(?\b(\d{3})\)?[\s.\-](\d{3})[\s.\-](\d{4})\b"
SSN = r"\b(\d{3})-(\d{2})-(\d{4})\b"
BARE_ID = r"\b[A-Z0-9]{2,8}-[A-Z0-9]{2,8}-[A-Z0-9]{2,8}(?:-[A-Z0-9]{2,8})*\b"
DATES = [
    ("iso", r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\d-\d\d-"),
    ("numeric", r"\b(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})\b", r"\d[/\-]\d{1,2}[/\-]\d"),
    ("month range", rf"(?i)\b{_MONTH}\.?\s*-\s*{_MONTH}\.?\s+\d{{4}}\b", r"[A-Za-z]\.?\s*-\s*[A-Za-z]{3,9}\.?\s+\d{4}"),
    ("month day year", rf"(?i)\b{_MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b", r"(?i)[a-z]\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}"),
    ("day of month", rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+of\s+{_MONTH}\.?,?\s+\d{{4}}\b", r"(?i)\d(?:st|nd|rd|th)?\s+of\s"),
    ("day month", rf"(?i)\b\d{{1,2}}\s+{_MONTH}\.?,?\s+\d{{4}}\b", r"\d\s+[A-Za-z]{3,9}\.?,?\s+\d{4}"),
    ("month year", rf"(?i)\b{_MONTH}\.?\s+(?:of\s+)?\d{{4}}\b", r"[A-Za-z]\.?\s+\d{4}|(?i)\sof\s+\d{4}"),
    ("slash year", r"\b(0?[1-9]|1[0-2])/((?:19|20)\d{2})\b", r"\d/(?:19|20)\d\d"),
    ("late early", r"(?i)\b(late|early)\s+(\d{4})\b", r"(?i)(?:late|early)\s+\d{4}"),
]


_MONTH_FIRST = "[" + "".join(sorted({m[0] for m in fv.MONTH_NAMES})) + "]"
#: What matches of a pass begin with; letter case is that of its pattern.
FIRST = {
    **dict.fromkeys(("ssn", "ip", "street", "age in years", "date short", "date iso", "date numeric", "date day of month", "date day month", "date slash year"), r"\d"),
    **dict.fromkeys(("date month range", "date month day year", "date month year"), _MONTH_FIRST),
    **dict.fromkeys(("facility", "provider credentialed", "city state"), "[A-Z]"),
    "ssn labelled": '[S"]', "npi": '[N"]', "dea": '[D"]', "device": "[SLRCUDI]", "phone": r"[(\d]", "phone labelled": "[PTCMOD]", "mrn": '[M"CRP]',
    "member id": '[MHBP"]', "vehicle": "[VLP]", "license": "[LS]", "account": "[ACGR]", "email": r"[A-Za-z0-9._%+\-]", "url": "h", "dob": '[D"]',
    "date late early": "[LE]", "po box": "P", "city labelled": '[C"]', "age stated": "A", "provider titled": "D", "bare id": "[A-Z0-9]",
}


def _group(group: int) -> Callable[[Column], Column]:
    return lambda m: m[f"g{group}"]


def _number(cat: str, group: int = 0) -> dict:
    return {"cat": cat, "raw": _group(group)}


def _keyed(cat: str, group: int, key: Callable[[Column], Column]) -> dict:
    return {"cat": cat, "raw": _group(group), "key": lambda m: key(m[f"g{group}"])}


def _single(token: str, group: int = 0) -> dict:
    return {"cat": None, "raw": _group(group), "key": lambda m: F.lit(token)}


def _folded(c: Column) -> Column:
    return F.lower(tx.strip(c))


def _labelled(sep: str = ": "):
    """label, separator, quote, token, quote."""
    return lambda token, m: F.concat(m["g1"], F.lit(sep), m["g2"], token, m["g2"])


def _after_label(token: Column, m: Column) -> Column:
    return F.concat(m["g1"], F.lit(": "), token)


def _is_old(m: Column) -> Column:
    return m["g1"].cast("int") >= 90


_AGE = {"cat": None, "raw": lambda m: F.when(_is_old(m), "90+").otherwise(m["g0"]),
        "key": lambda m: F.when(_is_old(m), "[AGE_90PLUS]").otherwise("[AGE]")}


def _short_date(m: Column) -> Column:
    """A day without a year counts only after a date word, never as a fraction or scale."""
    scale = m["g0"].rlike(r"^[0-5]/5$|^\d{1,2}/10$|^20/(?:20|25|30|40|50|70|100|200)$")
    return ~scale & ~F.right(m["ahead"], F.lit(15)).rlike(CLINICAL_CONTEXT) & m["ahead"].rlike(DATE_CONTEXT)


def _city_state(m: Column) -> Column:
    ahead, city, state, behind = m["ahead"], m["g1"], m["g2"], m["g3"]
    geographic_md = behind.rlike(r"^\s*\d{5}") | ahead.rlike(r"\d{1,5}\s+[A-Z]")
    return (
        state.isin(fv.STATE_CODES) & ~F.upper(city).isin(fv.CLINICAL_NAME_STOPLIST)
        & ~F.right(ahead, F.lit(5)).rlike(edges(r"\b(?:Dr|Mr|Ms|Mrs|Mx)\.?\s*\z")) & ~behind.rlike("^-[A-Za-z]")
        & ((state != "MD") | geographic_md)
    )


def _relocation(m: Column) -> Column:
    words = F.transform(F.split(m["g1"], r"\s+"), F.upper)
    return ~F.exists(words, lambda w: w.isin(fv.LOCATION_ABBREVIATIONS)) & ~F.forall(words, lambda w: w.isin(fv.CLINICAL_NAME_STOPLIST))


def passes_before_cities() -> list[Pass]:
    p: list[Pass] = []

    def add(name, pattern, hint, how, **kw):
        p.append(Pass(name, led(FIRST[name], edges(pattern)) if name in FIRST else edges(pattern), hint, **how, **kw))

    q = r'\s*[:\-]?\s*("?)'
    add("ssn labelled", rf'(?i){_START}(SSN|Social\s+Security(?:\s+Number)?|"ssn"){_NO_LETTER}\s*[:\-#]?\s*("?)(\d{{3}}[\s\-]\d{{2}}[\s\-]\d{{4}})\2',
        r"\d{3}[\s\-]\d{2}[\s\-]\d{4}", _number("SSN", 3), render=_labelled(), groups=3)
    add("ssn", SSN, r"\d{3}-\d{2}-\d{4}", _number("SSN"))
    add("npi", rf'(?i){_START}(NPI\s*#?|"npi"){_NO_LETTER}{q}(\d{{10}})\2', r"(?i)npi", _number("NPI", 3), render=_labelled(), groups=3)
    add("dea", rf'(?i){_START}(DEA\s*#?|"dea"){_NO_LETTER}{q}([A-Z]{{2}}\d{{7}})\2', r"(?i)dea", _number("DEA", 3), render=_labelled(), groups=3)
    add("device", rf"(?i)\b(Serial(?:\s*(?:Number|No\.?|#))?|Ser\.?|S/N|SN|Lot(?:\s*#)?|REF|Catalog(?:\s*#)?|Cat\.?\s*#|UDI|Device\s*ID|Implant\s*ID){_NO_LETTER}\s*[:#\-]?\s*([A-Z0-9][A-Z0-9\-/]{{3,}})\b",
        r"(?i)ser|s/n|sn|lot|ref|cat|udi|device|implant", _number("DEVICE", 2), render=_after_label, groups=2)
    add("fax", rf"(?i)(Fax\s*#?){_NO_LETTER}\s*[:\-]?\s*(\(?\d{{3}}\)?[\s.\-]\d{{3}}[\s.\-]\d{{4}})\b", r"(?i)fax", _number("FAX", 2), render=_after_label, groups=2)
    add("phone", PHONE, r"\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}", _single("[PHONE]"))
    add("phone labelled", rf"(?i)\b(Phone|Ph\.?|Tel(?:ephone)?|Cell|Mobile|Office|Direct|Contact\s*(?:number|no\.?)|Call){_NO_LETTER}\s*[:#\-]?\s*((?:\+?1[\s.\-]?)?\d{{10}})\b",
        r"\d{10}", _single("[PHONE]", 2), render=_after_label, groups=2)
    add("mrn", rf'(?i){_START}(mrn|"mrn"|chart\s*(?:number|no\.?|#)?|record\s*(?:number|no\.?|#)?|patient\s*(?:id|number|no\.?|#)|"medical_record_number"){_NO_LETTER}(\s*[:\-#]?\s*)("?)([A-Z0-9][A-Z0-9\-]{{3,}})\3',
        r"(?i)mrn|chart|record|patient", _single("[MRN]", 4), render=lambda t, m: F.concat(m["g1"], m["g2"], m["g3"], t, m["g3"]), groups=4)
    add("member id", rf'(?i){_START}(Member\s+ID|Health\s+Plan\s+ID|Beneficiary\s+ID|Policy\s+#|Policy\s+Number|"member_id"){_NO_LETTER}{q}{_ID}\2',
        r"(?i)member|plan|beneficiary|policy", _number("MEMBERID", 3), render=_labelled(), groups=3)
    add("vehicle", rf"(?i)\b(VIN|License\s+Plate|Plate\s*#?){_NO_LETTER}\s*[:\-#]?\s*{_ID}\b", r"(?i)vin|plate", _number("VEHICLE", 2), render=_after_label, groups=2)
    add("license", rf"(?i)\b(License|Lic\.?|State\s+License){_NO_LETTER}\s*#?\s*[:\-]?\s*{_ID}\b", r"(?i)lic", _number("LICENSE", 2), render=_after_label, groups=2)
    add("account", rf"(?i)\b(Account|Acct|Claim|Auth(?:orization)?|Group|Ref(?:erence)?){_NO_LETTER}\s*(?:#|No\.?)\s*[:\-]?\s*{_ID}\b",
        r"(?i)acc|claim|auth|group|ref", _number("ACCOUNT", 2), render=_after_label, groups=2)
    add("email", EMAIL, "@", _number("EMAIL"))
    add("url", URL, "https?://", _number("URL"))
    add("ip", IPV4, r"\d\.\d{1,3}\.\d{1,3}\.\d", _number("IP"))
    add("dob", rf'(?i){_START}(d\.?o\.?b\.?|date\s+of\s+birth|"date_of_birth"){_NO_LETTER}{q}(\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}}|{_MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}})\2',
        r"(?i)d\.?o\.?b|birth", _single("[DOB]", 3), render=_labelled(), groups=3)
    for name, pattern, hint in DATES:
        add(f"date {name}", pattern, hint, _keyed("DATE", 0, _folded))
    add("date short", r"(?<!\w)(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])\b(?!/)", r"\d/\d", _keyed("DATE", 0, _folded), keep=_short_date, context=25)
    add("po box", r"(?i)\bP\.?\s?O\.?\s*Box\s+\d+\b", r"(?i)box", _single("[ADDRESS]"))
    add("street", STREET, r"\d\s+[A-Z]", _single("[ADDRESS]"))
    add("city labelled", rf"""{_START}(City|"city"){_NO_LETTER}\s*[:\-]?\s*("?)([A-Z][a-zA-Z .'\-]+?)\2(?=[,\n"]|\z)""", r"[Cc]ity",
        _keyed("CITY", 3, _folded), render=_labelled(), groups=3)
    add("city state", rf"(?<!\w)([A-Z][a-zA-Z.'\-]+(?:\s+[A-Z][a-zA-Z.'\-]+)?),\s*([A-Z]{{2}})\b{after(10)}", r",\s*[A-Z]{2}",
        _keyed("CITY", 1, _folded), render=lambda t, m: F.concat(t, F.lit(", "), m["g2"]), keep=_city_state, groups=3, context=20)
    zip_kept = lambda m: ~F.right(F.concat(m["ahead"], m["g1"]), F.lit(20)).rlike(CODE_CONTEXT)
    for name, lead, hint in (("state", r",\s*[A-Z]{2}\s+", r"[A-Z]{2}\s+\d{5}"), ("token", r"\[(?:ADDRESS|CITY_\d+)\][,\s]{1,4}", r"\][,\s]{1,4}\d{5}")):
        add(f"zip after {name}", rf"({lead})(\d{{5}}(?:-\d{{4}})?)\b", hint, _number("ZIP", 2), keep=zip_kept, context=20, groups=2,
            render=lambda t, m: F.concat(m["g1"], t))
    add("age in years", r"(?i)\b(\d{1,3})[- ]year[- ]old\b", r"(?i)year[- ]old", _AGE, groups=1)
    add("age stated", r"(?i)\bage\s+(\d{1,3})\b", r"(?i)age\s+\d", _AGE, groups=1)
    add("facility", FACILITY, r"Hospital|Clinic|Center|System|Orthopedic", _single("[FACILITY]"))
    add("provider titled", r"\bDr\.?[ \t]+([A-Z][a-zA-Z'\-]+(?:[ \t]+[A-Z][a-zA-Z'\-]+)?)\b", r"Dr\.?[ \t]", _keyed("PROVIDER", 0, tx.surname_key), groups=1)
    add("provider credentialed", rf"\b([A-Z][a-zA-Z'\-]+(?:[ \t][A-Z]\.?)?(?:[ \t][A-Z][a-zA-Z'\-]+)?),?[ \t]+{_CREDENTIAL}\b", r"[ \t](?:MD|D\.?O|PA-C|NP|RN|DPM)",
        _keyed("PROVIDER", 1, tx.surname_key), render=lambda t, m: F.concat(t, F.lit(", "), m["g2"]), groups=2)
    return p


def passes_after_cities() -> list[Pass]:
    contact = rf"(?i)\b(Emergency\s+contact|Spouse|Wife|Husband|Next\s+of\s+kin|Guardian|Caregiver|Contact\s+person)(\s+name)?\s*[:\-]\s*({_NAME_WORDS})"
    return [
        Pass("relocation city", led("[rmltcohb]", edges(rf"\b(?:{LOCATION_WORDS})\s+([A-Z][A-Za-z]{{2,}}(?:\s+[A-Z][A-Za-z]{{2,}}){{0,2}})\b")),
             r"(?:from|to|in)\s+[A-Z]", **_keyed("CITY", 1, _folded), keep=_relocation, groups=1,
             render=lambda t, m: F.concat(F.substring(m["g0"], F.lit(1), F.length(m["g0"]) - F.length(m["g1"])), t)),
        Pass("contact", led("[ESWHNGC]", edges(contact)), r"(?i)contact|spouse|wife|husband|kin|guardian|caregiver", **_keyed("CONTACT", 3, _folded), groups=3,
             render=lambda t, m: F.concat(m["g1"], m["g2"], F.lit(": "), t)),
    ]


BARE_ID_PASS = Pass("bare id", led(FIRST["bare id"], edges(BARE_ID)), r"[A-Z0-9]-[A-Z0-9]{2,8}-[A-Z0-9]", **_number("ACCOUNT"),
                    keep=lambda m: m["g0"].rlike("[A-Z]") & m["g0"].rlike("[0-9]"))


# ---- sweeps ------------------------------------------------------------------------

_LONGEST_FIRST = sorted(fv.METRO_CITIES, key=lambda c: -len(c))
_CITY_MARK, _NAME_MARK = "\x01", "\x02"


def metro_cities(df: DataFrame) -> DataFrame:
    """Gazetteer cities, longest first, unless part of a person's or a longer name.

    The fold leaves a numbered mark per city; one keyed pass turns marks into tokens.
    """
    text = F.col("_text")
    cities = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(i).alias("i")) for i, c in enumerate(_LONGEST_FIRST)])
    honorific, front = F.lit(edges(r"(\b(?:Dr|Mr|Ms|Mrs|Mx)\.?[ \t]+)")), F.lit(edges(r"\b"))
    back = F.lit(edges(r"\b(?![ \t]+[A-Z][a-z])"))

    def step(t: Column, city: Column) -> Column:
        mark = F.concat(F.lit(_CITY_MARK), city["i"].cast("string"), F.lit(_CITY_MARK))
        # A person's name is set aside while the city is marked, whatever blanks follow the honorific.
        aside = F.regexp_replace(t, F.concat(honorific, city["c"], F.lit(edges(r"\b"))), F.lit("$1" + _NAME_MARK))
        return F.when(tx.contains(t, city["c"]), F.replace(F.regexp_replace(aside, F.concat(front, city["c"], back), mark), F.lit(_NAME_MARK), city["c"])).otherwise(t)

    marked = df.withColumn("_text", F.when(text.rlike("|".join(_LONGEST_FIRST)), F.aggregate(cities, text, step)).otherwise(text))
    names = F.array(*[F.lit(c) for c in _LONGEST_FIRST])
    city_of = lambda m: F.get(names, m["g1"].cast("int"))
    return run_pass(marked, Pass("metro city", f"{_CITY_MARK}(\\d+){_CITY_MARK}", _CITY_MARK, cat="CITY", raw=city_of,
                                 key=lambda m: F.lower(city_of(m)), order=lambda m: m["g1"].cast("int"), groups=1))


def replaced_names(text: Column, names: Column, token_of: Callable[[Column], Column], name_of: Callable[[Column], Column]) -> Column:
    def step(t: Column, e: Column) -> Column:
        pattern = F.concat(F.lit("(?i)" + tx.BEGIN), tx.literal(name_of(e)), F.lit("(?![A-Za-z0-9_])"))
        return F.regexp_replace(t, pattern, token_of(e))

    return F.aggregate(names, text, step)


def sweep_contacts(df: DataFrame) -> DataFrame:
    contacts = F.filter("_toks", lambda t: (t["cat"] == "CONTACT") & (F.length(t["key"]) >= 3))
    return df.withColumn("_text", replaced_names(F.col("_text"), contacts, lambda t: t["token"], lambda t: t["key"]))


def detected_name(text: Column) -> Column:
    """The patient's name: labelled, on a Re: line, as a LAST, FIRST header, or beside a DOB or MRN."""
    name = edges(rf"({_NAME_WORDS}(?:,?\s+{_SUFFIX})?)")
    labels = [r'"?patient_name"?\s*[:\-]\s*"?', r"""\bpatient(?:'s)?\s+name\s*[:\-]\s*"?""", r'\bpatient\s*[:\-]\s*"?', r'\bpt\.?\s*[:\-]\s*"?', r'\bname\s*[:\-]\s*"?']
    labelled = [F.when(text.rlike(r"(?i)patient|pt|name"), tx.extract(text, "(?i)" + edges(label) + name, 1)) for label in labels]
    re_line = tx.extract(text, edges(
        r"(?im)\bRe:\s*(?:Patient:?\s*)?([A-Z][A-Za-z'\-]+(?:,\s*[A-Z][A-Za-z'.\-]*)?(?:[ \t]+[A-Z][A-Za-z'.\-]*){0,2})(?=\s*[-,(]|\s+DOB|\s+MRN|[\r\n]|$)"), 1)
    header = r"^[ \t]*([A-Z][A-Za-z'\-]{1,30}),\s*([A-Z][A-Za-z'\-]{1,30})(?:\s+([A-Z])\.?)?[ \t]*$"
    clinical = lambda line, p: (F.upper(F.regexp_extract(line, p, 1)).isin(fv.CLINICAL_NAME_STOPLIST)
                                | F.upper(F.regexp_extract(line, p, 2)).isin(fv.CLINICAL_NAME_STOPLIST))
    marker = edges(r"(?i)\b(?:DOB|MRN)\b")
    lines = F.split(text, "\n")
    near = lambda i: F.exists(F.slice(lines, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)) + 3), lambda x: x.rlike(marker))
    indexed = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    heads = F.filter(indexed, lambda e: (F.length(e["x"]) <= 40) & e["x"].rlike(header) & ~clinical(e["x"], header) & ((e["i"] < 15) | near(e["i"])))
    pair = edges(r"\b([A-Z][A-Za-z'\-]+),\s*([A-Z][A-Za-z'\-]+)\b")
    marked = F.filter(lines, lambda x: x.rlike(marker) & x.rlike(pair) & ~clinical(x, pair))
    first = F.get(marked, F.lit(0))
    return tx.strip(F.coalesce(
        *labelled, re_line,
        F.when(text.rlike("(?m)" + header), F.get(heads, F.lit(0))["x"]),
        F.when(text.rlike(marker), F.concat(F.regexp_extract(first, pair, 1), F.lit(", "), F.regexp_extract(first, pair, 2)))))


PATIENT = "[PATIENT_NAME]"


def patient_entry(name: Column) -> Column:
    return _entry(F.lit("PATIENT_NAME"), F.lit(1), F.lit(PATIENT), name, F.lit(None).cast("string"))


def sweep_patient(df: DataFrame) -> DataFrame:
    """Every form of the patient's name becomes one token; a name already known is kept."""
    known = F.get(F.filter("_toks", lambda t: t["token"] == PATIENT), F.lit(0))["raw"]
    name = F.col("_name")
    named = df.withColumn("_known", known).withColumn("_name", F.when(F.col("_known").isNotNull(), F.col("_known")).otherwise(detected_name(F.col("_text"))))
    named = named.withColumn("_parts", F.when(name.isNotNull(), tx.name_parts(name)))
    named = named.withColumn("_variants", F.when(name.isNotNull(), tx.name_variants(F.col("_parts"))))
    swept = replaced_names(F.col("_text"), F.col("_variants"), lambda v: F.lit(PATIENT), lambda v: v)
    entry = patient_entry(name)
    return named.withColumns({
        "_text": F.when(name.isNotNull(), swept).otherwise(F.col("_text")),
        "_toks": F.when(name.isNotNull() & F.col("_known").isNull(), F.array_append("_toks", entry)).otherwise(F.col("_toks")),
    })


# ---- residual pass -------------------------------------------------------------------

# A chain of names as one loop over single characters, each allowed by its neighbours alone, so that a chain of any length
# needs no stack: small letters follow letters; capitals begin a word or follow small letters, and small letters or a
# hyphenated word follow them; apostrophes and hyphens stand before a word, blanks before blanks or a word.
_BEGIN = r"(?:[A-Z]-)?[A-Z][a-z]"
_NEXT = rf"(?<=[A-Za-z])[a-z]|[A-Z][a-z]|(?<![A-Za-z])[A-Z]-[A-Z][a-z]|[ \t](?:[ \t]|{_BEGIN})|['\-]{_BEGIN}"
_CHAIN = rf"(?={_BEGIN})[A-Z](?:(?={_NEXT}|(?<=[A-Z])-[A-Z][a-z])[A-Za-z'\- \t])+(?<=[a-z])"
RESIDUAL = rf"\[[A-Z][A-Z0-9_]*\]|{_CHAIN}|\d{{5,}}"


def allowlisted(span: Column, allow: Iterable[str]) -> Column:
    """The whole phrase is allowed, or it has several words and each one is."""
    words = sorted({" ".join(w.split()).lower() for w in allow})
    phrase = F.lower(tx.strip(F.regexp_replace(span, r"\s+", " ")))
    parts = F.filter(F.split(F.lower(span), r"[ \t]+"), lambda w: w != "")
    return phrase.isin(words) | ((F.size(parts) > 1) & F.forall(parts, lambda w: w.isin(words)))


MASK = "[REDACTED]"


def residual(df: DataFrame, allow: Iterable[str] | DataFrame) -> DataFrame:
    """Names and long numbers that no pass took become [REDACTED] in ``_text``, for good; ``_flagged`` counts them.

    ``allow`` is a short list, or a vocabulary table of any size (``vocabulary.table``), which is joined.
    """
    text = F.col("_text")

    def written(m: Column, allowed: Column) -> Column:
        kept = F.when(m.startswith("["), True).when(m.rlike(r"^\d"), F.length(m) == 5).otherwise(allowed)
        return F.when(kept, m).otherwise(MASK)

    masks = lambda a: F.size(F.filter(a, lambda x: x == MASK))
    found = df.withColumn("_hits", F.regexp_extract_all(text, F.lit(RESIDUAL), F.lit(0)))
    if isinstance(allow, DataFrame):
        found = settled(settled(found).withColumn("_row", F.monotonically_increasing_id()))
        names = found.select(F.col("_row").alias("row"), F.transform("_hits", lambda m: F.when(m.rlike("^[^\\[0-9]"), m)).alias("hits"))
        told = vocabulary.flags(names, allow).withColumnRenamed("row", "_row").withColumnRenamed("flags", "_flags")
        found = found.join(told, "_row", "left").withColumn("_new", F.zip_with("_hits", F.coalesce("_flags", F.array().cast("array<boolean>")), written)).drop("_row", "_flags")
    else:
        found = found.withColumn("_new", F.transform("_hits", lambda m: written(m, allowlisted(m, allow))))
    joined = F.array_join(F.zip_with(F.split(text, RESIDUAL, -1), F.array_append("_new", F.lit("")), lambda a, b: F.concat(a, b)), "")
    return found.withColumns({"_text": joined, "_flagged": masks("_new") - masks("_hits")})


# ---- whole documents -------------------------------------------------------------------

def tokenized(df: DataFrame, text: str, start: Column | None = None) -> DataFrame:
    """Adds ``_text`` and ``_toks``: all passes that need no name, going on from the tokens in ``start``."""
    work = df.withColumns({"_text": F.coalesce(tx.normalized(text), F.lit("")), "_toks": _no_tokens() if start is None else start})
    for p in passes_before_cities():
        work = run_pass(work, p)
    work = metro_cities(work)
    for p in passes_after_cities():
        work = run_pass(work, p)
    return work


def masked_names(work: DataFrame, allow: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """The patient's name, bare identifiers and what is left over; adds ``_flagged``."""
    words = allow if isinstance(allow, DataFrame) else list(allow if allow is not None else default_allowlist())
    return residual(run_pass(sweep_patient(work), BARE_ID_PASS), words)


def deidentify(df: DataFrame, text: str, allow: Iterable[str] | DataFrame | None = None, tokens: str | None = None, out: str = "redacted") -> DataFrame:
    """Adds ``out``, ``tokens`` and ``unclassified``.

    ``tokens`` names a token list to carry on from, so several texts of one case
    share numbering and the patient's name: call once per text, in order.  For
    any number of texts see ``seams.shared``.
    """
    start = F.coalesce(F.col(tokens).cast(TOKENS), _no_tokens()) if tokens else None
    work = masked_names(sweep_contacts(tokenized(df, text, start)), allow)
    return work.select(
        *[c for c in df.columns if c not in (out, "tokens", "unclassified")], F.col("_text").alias(out),
        F.col("_toks").alias("tokens"), F.col("_flagged").cast("bigint").alias("unclassified"))


def category(token: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(token, r"^\[|\]$", ""), r"_\d+$", ""))


def audit(df: DataFrame, key: str) -> DataFrame:
    """Distinct tokens per category and row; counts only, never a value."""
    counted = df.select(key, F.explode(F.transform("tokens", lambda t: category(t["token"]))).alias("category")).groupBy(key, "category").agg(F.count("*").alias("n"))
    masked = df.where("unclassified > 0").select(key, F.lit("unclassified_flagged").alias("category"), F.col("unclassified").alias("n"))
    return counted.unionByName(masked)


def token_map(df: DataFrame, key: str) -> DataFrame:
    """The restricted token table: what each token stands for."""
    return df.select(key, F.explode("tokens").alias("t")).select(key, "t.token", "t.raw")


# ---- restoring and re-applying -----------------------------------------------------------

def _longest_first(entries: Column, of: str) -> Column:
    keyed = F.transform(entries, lambda t: F.struct((-F.length(t[of])).alias("k"), t["token"].alias("token"), t["raw"].alias("raw")))
    return F.array_sort(keyed)


def reidentified(text: Column, tokens: Column) -> Column:
    """Tokens back to values, longest token first; [REDACTED] has none and stays."""
    return _restored(text, _longest_first(tokens, "token"))


def _restored(text: Column, ordered: Column) -> Column:
    return F.aggregate(ordered, text, lambda t, e: F.replace(t, e["token"], e["raw"]))


def _without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x01-\x1F\x7F-\x9F]", " ")


def reidentified_leaf(text: Column, tokens: Column) -> Column:
    """For a typed field: restored, with control characters blanked."""
    return _without_controls(reidentified(text, tokens))


def reidentified_record(df: DataFrame, column: str, tokens: str) -> DataFrame:
    """``df`` with every text in the typed record ``column`` restored; numbers, booleans and nulls stay as they are.

    The tokens are put in order once a row and not once a text.
    """
    kind = df.schema[column].dataType
    ordered = df.withColumn("_ordered", _longest_first(F.col(tokens), "token"))
    return ordered.withColumn(column, leaves.mapped(F.col(column), kind, lambda t: _without_controls(_restored(t, F.col("_ordered"))))).drop("_ordered")


def _known_values(tokens: Column) -> Column:
    """Values of three characters or more, longest first, with their length and the pattern that finds them."""
    ordered = _longest_first(F.filter(tokens, lambda t: F.length(t["raw"]) >= 3), "raw")
    return F.transform(ordered, lambda e: F.struct(F.length(e["raw"]).alias("n"), F.concat(F.lit("(?i)"), tx.literal(e["raw"])).alias("pattern"), e["token"].alias("token")))


def _masked(text: Column, values: Column) -> Column:
    # A text shorter than a value does not hold it, and most patterns are then not even compiled.
    return F.aggregate(values, text, lambda t, e: F.when(F.length(t) >= e["n"], F.regexp_replace(t, e["pattern"], e["token"])).otherwise(t))


def known_values_masked(text: Column, tokens: Column) -> Column:
    """Values already known become their tokens, longest value first, in any letter case."""
    return _masked(text, _known_values(tokens))


def masked_record(df: DataFrame, column: str, tokens: str) -> DataFrame:
    """``df`` with every known value in the texts of the typed record ``column`` masked; patterns are made once a row."""
    kind = df.schema[column].dataType
    known = df.withColumn("_values", _known_values(F.col(tokens)))
    return known.withColumn(column, leaves.mapped(F.col(column), kind, lambda t: _masked(t, F.col("_values")))).drop("_values")


def counters_only(tokens: Column) -> Column:
    """Known numbered tokens as counters: new tokens number past them, old values are not reused."""
    numbered = F.filter(tokens, lambda t: t["token"].rlike(r"^\[[A-Z]+_\d+\]$"))
    blank = F.lit(None).cast("string")
    return F.transform(numbered, lambda t: t.withField("raw", blank).withField("key", blank))


# ---- span table ----------------------------------------------------------------------------

SPAN_PATTERNS = {
    "ssn": edges(SSN), "phone": edges(PHONE), "email": edges(EMAIL), "url": edges(URL), "ip": edges(IPV4),
    "address": edges(STREET), "po_box": edges(r"(?i)\bP\.?\s?O\.?\s*Box\s+\d+\b"), "age": edges(r"(?i)\b(\d{1,3})[- ]year[- ]old\b"),
    "facility": edges(FACILITY), "provider_titled": edges(r"\bDr\.?[ \t]+([A-Z][a-zA-Z'\-]+(?:[ \t]+[A-Z][a-zA-Z'\-]+)?)\b"),
    "provider_credentialed": edges(rf"\b([A-Z][a-zA-Z'\-]+(?:[ \t][A-Z]\.?)?(?:[ \t][A-Z][a-zA-Z'\-]+)?),?[ \t]+{_CREDENTIAL}\b"),
    "bare_id": edges(BARE_ID),
    **{f"date_{name.replace(' ', '_')}": edges(pattern) for name, pattern, _ in DATES},
}
#: What every match of a category holds, found without looking at edges; a text without it is not searched.
SPAN_HINTS = {
    "ssn": r"\d-\d\d-\d{4}", "phone": r"\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}", "email": r"@[A-Za-z0-9.\-]", "url": "://", "ip": r"\d\.\d{1,3}\.\d{1,3}\.\d",
    "address": r"\d\s+[A-Z]", "po_box": r"(?i)Box\s+\d", "age": r"(?i)\d[- ]year", "facility": "Hospital|Clinic|Center|System|Orthopedic",
    "provider_titled": r"Dr\.?[ \t]+[A-Z]", "provider_credentialed": r"[ \t](?:MD|D\.?O|PA-C|NP|RN|DPM)", "bare_id": r"[A-Z0-9]-[A-Z0-9]{2,8}-[A-Z0-9]",
    **{f"date_{name.replace(' ', '_')}": hint for name, _, hint in DATES},
}


def _searched(category: str) -> str:
    return led(FIRST[category.replace("_", " ") if category.replace("_", " ") in FIRST else _PASS_OF[category]], SPAN_PATTERNS[category])


_PASS_OF = {"address": "street", "age": "age in years"}


def spans(df: DataFrame, key: str, text: str, *categories: str) -> DataFrame:
    """(key, category, pos, raw) of single patterns over the raw text; ``pos`` counts matches of one category."""
    hits = lambda c: F.when(F.col(text).rlike(SPAN_HINTS[c]), F.regexp_extract_all(text, F.lit(_searched(c)), F.lit(0)))
    found = F.array(*[F.struct(F.lit(c).alias("category"), hits(c).alias("hits")) for c in categories])
    per_category = df.select(key, F.explode(found).alias("f")).where(F.size("f.hits") > 0)
    return per_category.select(key, "f.category", F.posexplode("f.hits").alias("pos", "raw"))


def numbered_spans(span_table: DataFrame, key: str, start: DataFrame | None = None) -> DataFrame:
    """Token numbers of the span table: one per occurrence, and one per distinct value by first occurrence.

    ``start`` (key, category, last) continues after numbers already given.  The
    windows run within one text, so no group can outgrow that text's spans.
    """
    per = Window.partitionBy(key, "category")
    value = F.lower(F.trim("raw"))
    firsts = span_table.withColumn("first_pos", F.min("pos").over(Window.partitionBy(key, "category", value)))
    ranked = firsts.withColumn("occurrence", F.row_number().over(per.orderBy("pos"))).withColumn("value_no", F.dense_rank().over(per.orderBy("first_pos")))
    if start is None:
        return ranked.drop("first_pos")
    carried = ranked.join(start, [key, "category"], "left")
    last = F.coalesce("last", F.lit(0))
    return carried.withColumn("occurrence", F.col("occurrence") + last).withColumn("value_no", F.col("value_no") + last).drop("first_pos", "last")
