"""Personal data by weak supervision: patterns find candidates, labelers vote, EM weighs them, a classifier decides."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcase.llm.common import written

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that the regex engine needs no recursion and no run is scanned twice: a group loop is a
# loop over single characters that forbids two separators in a row; a run is entered at its start or at a match's end.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))*(?<!\.)"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[0-9 -](?<![ -]{2}))+(?<=[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Looser forms that only the classifier may accept.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]{2,63}",
    "ip": r"(?<![0-9])[0-9]{1,3}\[\.\][0-9]{1,3}\[\.\][0-9]{1,3}\[\.\][0-9]{1,3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
# Gazetteers and context words, by kind.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "us", "ca", "at", "ch", "nl", "test", "example")
CUES = {
    "email": "mail|contact|write to|correo|courriel|schreib|from",
    "ip": "address|host|server|client|login|ip",
    "card": "card|visa|credit|debit|payment|tarjeta|carte|karte|iban",
    "phone": "phone|call|tel|mobile|fax|reach|llam|appel|ruf",
}
COUNTER = r"version|release|section|chapter|license|isbn|figure|page|build|v$"
#: Characters of context before a candidate, and of the chunks they are read from (a text is scanned from its start for
#: any place in it).
CONTEXT, CHUNK = 32, 128
VOTES = ("form", "check", "gazetteer", "cue", "edge")

SPAN = "array<struct<s:int,e:int,m:string>>"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, gate: str) -> str:
    """SQL for the matches of ``pattern`` in ``text``: start, end (code points), text. Offsets add up what lies between
    matches and the matches, so the text is scanned twice whatever their number; texts that fail the gate are not. They
    are added in blocks of about the root of their number, for an array that grows is copied at each step."""
    p = quoted(pattern)
    parts = f"filter(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, m) -> struct(length(g) AS g, m AS m)), x -> x.m IS NOT NULL)"
    width = "greatest(int(ceil(sqrt(size(z)))), 1)"
    last = "get(done, size(done) - 1)"
    return f"""IF({gate}, get(transform(array({parts}), z -> flatten(aggregate(
        transform(sequence(0, int(floor(greatest(size(z) - 1, 0) / {width}))), k -> slice(z, k * {width} + 1, {width})),
        cast(array() AS array<{SPAN}>),
        (done, block) -> array_append(done, aggregate(block,
            struct(coalesce(get({last}, size({last}) - 1).e, 0) AS at, cast(array() AS {SPAN}) AS found),
            (a, x) -> struct(a.at + x.g + length(x.m) AS at, array_append(a.found, struct(a.at + x.g AS s, a.at + x.g + length(x.m) AS e, x.m AS m)) AS found),
            a -> a.found))))), 0), cast(array() AS {SPAN}))"""


def valid(kind: str, m: str) -> str:
    """SQL for the check that a match of this kind must pass."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "ip":
        part = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
        return f"({m} rlike '^{part}[.]{part}[.]{part}[.]{part}$')"
    if kind == "card":
        luhn = f"""aggregate(sequence(1, length({digits})), 0, (t, i) ->
            t + IF(i % 2 = 1, int(substring(reverse({digits}), i, 1)), (2 * int(substring(reverse({digits}), i, 1)) - IF(int(substring(reverse({digits}), i, 1)) > 4, 9, 0)))) % 10 = 0"""
        # A long run of digits fails by its length before any sum is taken.
        return f"(CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn} ELSE false END)"
    if kind == "phone":
        return f"(length({digits}) BETWEEN 9 AND 15)"
    return "true"


def gazetteer(kind: str, m: str) -> str:
    """SQL for a vote by lists: known endings, issuer digits, reserved addresses, country codes."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "email":
        return f"IF(lower({m}) rlike '({'|'.join(ENDINGS)})$', 1, -1)"
    if kind == "ip":
        return f"IF({m} rlike '^(0|127|255)[^0-9]', -1, 1)"
    if kind == "card":
        return f"IF({digits} rlike '^[3-6]', 1, -1)"
    return f"IF({digits} rlike '^0', 0, 1)"


def voted(kind: str, found: str, form: int) -> str:
    """SQL for candidates: spans with every labeler's vote (1 personal data, -1 not, 0 none) and a form flag."""
    chunk = lambda at: f"coalesce(get(chunks, int({at})), '')"
    ahead = f"right(concat({chunk(f'x.s div {CHUNK} - 1')}, substring({chunk(f'x.s div {CHUNK}')}, 1, x.s % {CHUNK})), {CONTEXT})"
    before = f"lower({ahead})"
    after = f"substring({chunk(f'x.e div {CHUNK}')}, x.e % {CHUNK} + 1, 1)"
    last = f"IF(x.s > 0, right({ahead}, 1), ' ')"
    return f"""transform({found}, x -> struct(x.s AS s, x.e AS e, {KINDS.index(kind)} AS kind,
        {form} AS form,
        {f"IF({valid(kind, 'x.m')}, 1, -1)"} AS check,
        {gazetteer(kind, 'x.m')} AS gazetteer,
        CASE WHEN {before} rlike {quoted(COUNTER)} THEN -1 WHEN {before} rlike {quoted(CUES[kind])} THEN 1 ELSE 0 END AS cue,
        IF({last} rlike '[A-Za-z0-9=]' OR {after} rlike '[A-Za-z0-9]', -1, 1) AS edge))"""


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``found``: all candidates of its whole ``text``, strict ones (form 1) and loose ones (form 0)."""
    digit = "text rlike '[0-9]'"
    gates = {"email": "contains(text, '@')", "ip": digit, "card": digit, "phone": "contains(text, '+')"}
    loose_gates = {"email": "(contains(text, 'at)') OR contains(text, 'at]'))", "ip": "contains(text, '[.]')", "phone": digit}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    parts = [voted(k, matches("text", patterns[k], gates[k]), 1) for k in KINDS]
    parts += [voted(k, matches("text", LOOSE[k], loose_gates[k]), 0) for k in LOOSE]
    pieces = f"IF({digit} OR contains(text, '@') OR contains(text, 'at)') OR contains(text, 'at]'), regexp_extract_all(text, '(?s).{{1,{CHUNK}}}', 0), cast(array() AS array<string>))"
    return docs.withColumn("chunks", F.expr(pieces)).withColumn("found", F.expr(f"concat({', '.join(parts)})")).drop("chunks")


@dataclasses.dataclass
class Model:
    """The classifier's weights (constant, then one for each vote) and what EM found of the labelers."""

    weights: list[float]
    prior: float
    reliability: dict[str, tuple[float, float]]


def fitted(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> Model:
    """EM over vote patterns with counts, then a logistic classifier on the expected labels.

    Labelers vote independently given the truth. The first guess is the majority; a pseudo-count keeps a labeler that
    never errs, or never votes, finite. At most 3^5 patterns: their number does not follow the data.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return Model([-1.0, 1.0, 1.0, 0.5, 0.5, 0.5], 0.5, {})
    belief = [1 / (1 + math.exp(-sum(v))) for v, _ in patterns]
    prior, tables = 0.5, []
    for _ in range(rounds):
        prior = (1 + sum(n * b for (_, n), b in zip(patterns, belief))) / (2 + total)
        tables = []
        for j in range(len(VOTES)):
            seen = {(y, v): 1.0 for y in (0, 1) for v in (-1, 0, 1)}
            for (votes, n), b in zip(patterns, belief):
                seen[1, votes[j]] += n * b
                seen[0, votes[j]] += n * (1 - b)
            sums = {y: sum(seen[y, v] for v in (-1, 0, 1)) for y in (0, 1)}
            tables.append({k: c / sums[k[0]] for k, c in seen.items()})
        belief = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[1, v] / t[0, v]) for t, v in zip(tables, votes))
            belief.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    weights = [0.0] * (len(VOTES) + 1)
    for step in range(2000):
        slope = [-0.002 * w for w in weights]
        for (votes, n), b in zip(patterns, belief):
            z = weights[0] + sum(w * v for w, v in zip(weights[1:], votes))
            gap = (b - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * n / total
            for k, v in enumerate((1, *votes)):
                slope[k] += gap * v
        weights = [w + 2.0 * s for w, s in zip(weights, slope)]
    reliability = {name: (t[1, 1], t[0, -1]) for name, t in zip(VOTES, tables)}
    return Model(weights, prior, reliability)


def trained(found: DataFrame) -> Model:
    """A model from the candidates of all documents: counted by vote pattern, so only those counts reach the driver."""
    rows = found.select(F.explode("found").alias("c")).groupBy(*[F.col(f"c.{v}").alias(v) for v in VOTES]).count().collect()
    return fitted(sorted((tuple(r[v] for v in VOTES), r["count"]) for r in rows))


def decided(found: DataFrame, model: Model) -> DataFrame:
    """``found`` with ``base`` and ``spans``: base spans, and these with the loose candidates the classifier accepts that
    overlap none of them. Arrays of (s, kind, e), sorted by start, then kind as listed."""
    score = " + ".join([f"({model.weights[0]!r}D)", *(f"({w!r}D) * c.{v}" for w, v in zip(model.weights[1:], VOTES))])
    pick = "transform(filter(found, c -> {0}), c -> struct(c.s AS s, c.kind AS kind, c.e AS e))"
    base = found.withColumn("base", F.expr(f"array_sort({pick.format('c.form = 1 AND c.check = 1')})"))
    more = pick.format(f"c.form = 0 AND ({score}) >= 0 AND NOT exists(base, b -> b.s < c.e AND c.s < b.e)")
    return base.withColumn("spans", F.expr(f"array_sort(concat(base, {more}))"))


def joined(spans: str) -> str:
    """SQL for kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, c -> concat({names}[c.kind], ':', c.s, ':', c.e)), ',')"


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row: spans of personal data in whole texts.

    Built of SQL functions only. Base matches are leftmost and do not overlap within a kind; those that fail their check
    are dropped. Null and empty texts have no spans. Rows are independent but for the votes that train the model:
    repeated rows count each. A null id is kept; other columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    found = written(candidates(rows).select("doc_id", "found"))
    return decided(found, trained(found)).select("doc_id", "base", "spans")


def redacted(docs: DataFrame, n_chars: str | None = None) -> DataFrame:
    """``docs``, all columns, with every span of its text replaced by its kind in brackets; ``n_chars`` counts anew.

    Spans that overlap an earlier one are cut to what lies beyond it. The texts are read twice: for the votes of all
    documents, then to decide; nothing is shuffled but the vote counts.
    """
    plain = docs.select(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    model = trained(candidates(plain).select("found"))
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    text = F.expr(f"""IF(size(spans) = 0, text, aggregate(spans, struct('' AS made, 0 AS at),
        (a, x) -> IF(x.e <= a.at, a, struct(concat(a.made, substring(text, a.at + 1, greatest(x.s - a.at, 0)), {names}[x.kind]) AS made, x.e AS at)),
        a -> concat(a.made, substring(text, a.at + 1))))""")
    out = decided(candidates(kept), model).withColumn("clean", text)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("clean").alias("text"))
        elif c == n_chars:
            columns.append(F.length("clean").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return out.select(*columns)
