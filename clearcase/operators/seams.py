"""Any number of texts of one case under one numbering: chart, letter, supplements, turns.

Every text is redacted on its own with numbers of its own. What the texts of a case share, its contacts and its patient's
name, is then looked up case by case, and the numbers are given over the token table: by occurrence or by first
appearance of a value, over (case, category, seam, place). One fold per text writes them back. The plan has the same
size whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clearcase.operators import deid
from clearcase.sources.tables import settled

LOCAL = r"\[([A-Z]+)_(\d+)\]"
#: A contact's number in its case, while other tokens still have their text's numbers.
CARRIED = "CONTACTG"


def numbered(tokens: DataFrame, case: str, seam: str, place: str, category: str = "category", value: str = "value") -> DataFrame:
    """Adds ``number``: 1, 2, ... within (case, category), over seams in order and places within a seam.

    A token without a ``value`` is numbered by occurrence; equal values share the number of their first appearance. The
    two kinds of a category are counted apart.
    """
    at = F.struct(F.col(seam), F.col(place))
    running = W.partitionBy(case, category).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    rows = tokens.withColumn("_at", at)
    each = rows.where(F.col(value).isNull()).withColumn("number", F.count("*").over(running))
    keyed = rows.where(F.col(value).isNotNull())
    firsts = keyed.groupBy(F.col(case).alias("_c"), F.col(category).alias("_k"), F.col(value).alias("_v")).agg(F.min("_at").alias("_first"))
    firsts = firsts.withColumn("number", F.count("*").over(W.partitionBy("_c", "_k").orderBy("_first").rowsBetween(W.unboundedPreceding, 0)))
    same = keyed[case].eqNullSafe(F.col("_c")) & (keyed[category] == F.col("_k")) & (keyed[value] == F.col("_v"))
    keyed = keyed.join(firsts.hint("merge"), same).select(*rows.columns, "number")
    return each.unionByName(keyed).drop("_at")


def _spliced(text: Column, numbers: Column) -> Column:
    """A text's own token numbers replaced by its case's: ``numbers`` holds them by category, in the order of the own ones."""
    cats, own = (F.regexp_extract_all(text, F.lit(LOCAL), F.lit(g)) for g in (1, 2))

    def token(cat: Column, n: Column) -> Column:
        given = F.coalesce(F.get(numbers[cat], n.try_cast("int") - 1).cast("string"), n)
        return F.concat(F.lit("["), F.when(cat == CARRIED, "CONTACT").otherwise(cat), F.lit("_"), given, F.lit("]"))

    parts = F.split(text, LOCAL, -1)
    return F.array_join(F.zip_with(parts, F.array_append(F.zip_with(cats, own, token), F.lit("")), lambda a, b: F.concat(a, b)), "")


def _own_number(t: Column) -> Column:
    return t["token"] == F.concat(F.lit("["), t["cat"], F.lit("_"), t["n"].cast("string"), F.lit("]"))


def shared(df: DataFrame, case: str, order: list[str], text: str, allow: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """``df`` with ``redacted``, ``tokens`` (those that the text uses), ``known`` (how many the case has so far) and
    ``unclassified``.

    Texts of a case stand by ``order``. A contact named in one text is masked in that and all later ones, likewise the
    patient's name. A null case is a case; a null text is empty; text that looks like a token of the case is numbered as
    one. An empty table gives an empty one.
    """
    seam = F.row_number().over(W.partitionBy("_case").orderBy(*order))
    placed = df.withColumn("_case", F.to_json(F.struct(F.col(case).alias("c")))).withColumn("_seam", seam)
    first = settled(deid.tokenized(settled(placed).withColumn("_uid", F.monotonically_increasing_id()), text))

    spoken = first.select("_case", "_seam", F.explode(F.filter("_toks", lambda t: t["cat"] == "CONTACT")).alias("t")).select("_case", "_seam", "t.n", "t.key")
    firsts = spoken.groupBy("_case", "key").agg(F.min(F.struct("_seam", "n")).alias("at"))
    firsts = firsts.select("_case", F.row_number().over(W.partitionBy("_case").orderBy("at")).alias("number"), F.col("at._seam").alias("since"), "key")
    contacts = firsts.groupBy("_case").agg(F.array_sort(F.collect_list(F.struct("number", "since", "key"))).alias("_contacts"))
    heard = F.filter("_contacts", lambda c: (c["since"] <= F.col("_seam")) & (F.length(c["key"]) >= 3))
    swept = deid.replaced_names(F.col("_text"), heard, lambda c: F.concat(F.lit(f"[{CARRIED}_"), c["number"].cast("string"), F.lit("]")), lambda c: c["key"])
    work = first.join(contacts, "_case", "left").withColumn("_text", F.when(F.col("_contacts").isNotNull(), swept).otherwise(F.col("_text"))).drop("_contacts")
    work = settled(work.withColumn("_found", deid.detected_name(F.col("_text"))))

    names = work.where(F.col("_found").isNotNull()).groupBy("_case").agg(F.min(F.struct("_seam", "_found")).alias("_who"))
    entry = deid.patient_entry(F.col("_who._found"))
    work = work.drop("_found").join(names, "_case", "left")
    work = work.withColumn("_toks", F.when(F.col("_who._seam") < F.col("_seam"), F.array_append("_toks", entry)).otherwise(F.col("_toks"))).drop("_who")
    done = settled(deid.masked_names(work, allow).select(*df.columns, "_case", "_seam", "_uid", "_text", "_toks", "_flagged"))

    rows = done.select("_case", "_seam", "_uid", F.explode("_toks").alias("t"))
    own = rows.where(_own_number(F.col("t"))).select("_case", "_seam", "_uid", F.col("t.cat").alias("category"), F.col("t.n").alias("n"), F.col("t.key").alias("value"))
    given = settled(numbered(own, "_case", "_seam", "n").select("_case", "_seam", "_uid", "category", "n", "number"))
    lists = given.groupBy("_uid", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "number"))), lambda x: x["number"]).alias("numbers"))
    lists = lists.groupBy("_uid").agg(F.map_from_entries(F.collect_list(F.struct("category", "numbers"))).alias("_numbers"))

    named = given.select("_case", "_seam", F.concat_ws("_", "category", F.col("number").cast("string")).alias("name"))
    named = named.unionByName(rows.where(~_own_number(F.col("t"))).select("_case", "_seam", F.col("t.token").alias("name")))
    news = named.groupBy("_case", "name").agg(F.min("_seam").alias("_seam")).groupBy("_case", "_seam").agg(F.count("*").alias("_news"))
    so_far = F.sum(F.coalesce("_news", F.lit(0))).over(W.partitionBy("_case").orderBy("_seam").rowsBetween(W.unboundedPreceding, 0))
    out = done.join(lists, "_uid", "left").join(news, ["_case", "_seam"], "left").withColumn("known", so_far)
    renamed = lambda t: t.withField("token", _spliced(t["token"], F.col("_numbers")))
    return out.select(
        *df.columns, _spliced(F.col("_text"), F.col("_numbers")).alias("redacted"), F.transform("_toks", renamed).alias("tokens"), "known",
        F.col("_flagged").cast("bigint").alias("unclassified"),
    )
