"""Vocabularies, typed leaves, sketches, keyed tables and appends."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearcase.functions import leaves
from clearcase.operators import deid
from clearcase.operators import events as ev
from clearcase.operators import vocabulary as vo
from clearcase.sources import keyed, ledger
from clearcase.sources import tables as tb

SPANS = ["Knee Pain", "Pain", "Knee", "Left  Knee\tPain", "Rotator Cuff", "Cuff", "Ada Okoye", "Knee Okoye", "word 7", "Word  900000", "", None]


def test_a_vocabulary_of_a_million_phrases(spark):
    words = spark.range(1_000_000).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("phrase"))
    table = vo.table(words.unionByName(spark.createDataFrame([("Knee",), ("pain ",), ("left",), ("rotator  cuff",), (None,), (" ",)], "phrase string")))
    spans = spark.createDataFrame([(k, s) for k, s in enumerate(SPANS)], "k int, raw string")
    found = {r["raw"]: r["allowed"] for r in vo.known(spans, table).collect()}
    assert found == {"Knee Pain": True, "Pain": True, "Knee": True, "Left  Knee\tPain": True, "Rotator Cuff": True, "Cuff": False, "Ada Okoye": False,
                     "Knee Okoye": False, "word 7": True, "Word  900000": True, "": False}
    assert {r["raw"] for r in vo.unknown(spans, table).collect()} == {"Cuff", "Ada Okoye", "Knee Okoye", "", None}


def test_a_vocabulary_table_masks_what_a_list_masks(spark):
    words = deid.default_allowlist()
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["Knee", "Pain", "Ada", "Okoye", "Left", "Shoulder", "Zeb", "12345", "1234567", "ran", "to", "[DATE_1]"]) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "", None])], "k int, text string")
    table = vo.table(spark.createDataFrame([(w,) for w in words], "phrase string"))
    pick = lambda rows: sorted((r["k"], r["redacted"], r["unclassified"]) for r in rows.collect())
    assert pick(deid.deidentify(df, "text", table)) == pick(deid.deidentify(df, "text", words))


KIND = "struct<a:string,n:int,b:boolean,list:array<struct<t:string,d:double,tags:array<string>>>,map:map<string,string>,deep:map<string,array<struct<x:string>>>,none:struct<q:string>,day:date>"


def test_every_text_leaf_and_nothing_else(spark):
    record = ("[A] x", 3, True, [("[A]", 1.5, ["[B]", None]), None], {"[A]": "[A]", "k": None}, {"k": [("[B]",)]}, None, None)
    df = spark.createDataFrame([(record,), (None,)], f"r {KIND}")
    entry = lambda t, raw: F.struct(F.lit("A").alias("cat"), F.lit(1).alias("n"), F.lit(t).alias("token"), F.lit(raw).alias("raw"), F.lit(None).cast("string").alias("key"))
    df = df.withColumn("tokens", F.array(entry("[A]", "Ada\nL"), entry("[B]", "Bo")).cast(deid.TOKENS))
    done = deid.reidentified_record(df, "r", "tokens")
    assert T._parse_datatype_string(KIND).simpleString() == done.schema["r"].dataType.simpleString()
    one, other = [r["r"] for r in done.collect()]
    assert other is None
    assert one.asDict(recursive=True) == {
        "a": "Ada L x", "n": 3, "b": True, "list": [{"t": "Ada L", "d": 1.5, "tags": ["Bo", None]}, None], "map": {"[A]": "Ada L", "k": None},
        "deep": {"k": [{"x": "Bo"}]}, "none": None, "day": None}
    assert not leaves.has_text(T._parse_datatype_string("struct<a:int,m:map<string,int>>"))


def test_latency_sketches_on_skewed_values(spark):
    draw = random.Random(9)
    values = [int(draw.paretovariate(0.6) * 10) for _ in range(40_000)]
    rows = [(1, "pa_generation_succeeded", f'{{"payer":"p{k % 50 // 49}","duration_ms":{v}}}') for k, v in enumerate(values)]
    events = spark.createDataFrame(rows, "id int, event string, props string").repartition(16)
    found = ev.latency_quantiles(events, [0.01, 0.5, 0.9, 0.999]).collect()
    assert len(found) == 8 and all(r["within"] for r in found)


def table_of(spark, path):
    return sorted(tuple(r) for r in keyed.read(spark, path).select("id", "v").collect())


def test_upserts_rewrite_only_their_buckets_and_may_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark.createDataFrame([(k, f"a{k}", k) for k in range(100)] + [(5, "later", 99), (None, "x", 1)], "id int, v string, at int"), path, "id", 8, "at")
    want = {k: f"a{k}" for k in range(100)} | {5: "later"}
    assert table_of(spark, path) == sorted(want.items())
    files = {str(p) for p in (tmp_path / "t").rglob("*.parquet")}
    changes = spark.createDataFrame([(7, "b7", 1), (7, "c7", 2), (200, "new", 1), (None, "x", 1)], "id int, v string, at int")
    for _ in range(2):
        keyed.upsert(changes, path, "id", 8, "at")
        assert table_of(spark, path) == sorted((want | {7: "c7", 200: "new"}).items())
    kept = files & {str(p) for p in (tmp_path / "t").rglob("*.parquet")}
    assert len(kept) >= len(files) - 2 * len({p.rsplit("/", 1)[0] for p in files}) // 8
    added = keyed.upsert(changes.withColumn("id", F.col("id") + 1), path, "id", 8, "at", replace=False)
    assert {r["id"] for r in added.collect()} == {201} and dict(table_of(spark, path))[8] == "a8"
    assert keyed.upsert(changes.limit(0), path, "id", 8, "at").count() == 0


def test_appends_take_effect_once(spark, tmp_path):
    path = str(tmp_path / "u")
    rows = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-02-03")], "id int, day string").withColumn("created_at", F.to_timestamp("day"))
    for batch in ("b1", "b1", "b2"):
        tb.append_usage(rows, path, batch=batch)
    assert ledger.read(spark, path).count() == 4 and ledger.committed(spark, path).count() == 2
    # A batch whose data was written before a crash, but not its line in the manifest, does not count until it is repeated.
    rows.withColumn("period", F.lit("2024-01")).write.partitionBy("period").parquet(f"{path}/data/job=usage/batch=b3")
    assert ledger.read(spark, path).count() == 4
    tb.append_usage(rows, path, batch="b3")
    assert ledger.read(spark, path).count() == 6
    with pytest.raises(Exception):
        ledger.read(spark, str(tmp_path / "absent"))
