"""Quality by hierarchical empirical Bayes: a text's own evidence on top of what its host and path are known for."""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearcase.llm.common import in_fold, text_slices, written

#: Labelled rows of each class that the classifier is fitted on at most; site rates cover all rows.
SAMPLE = 5000
#: Path rows up to which their rates are broadcast (under 10 MB); more are joined by a salted shuffle.
SMALL, SALTS = 100_000, 32
MARKS = "!|*$%&#@^~<>{}[]\\/_=+"


@dataclasses.dataclass
class Model:
    """Weights over scaled features; ``prior`` is the share of good rows they were fitted at."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    prior: float


def features(text: str) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    return [
        math.log1p(len(words)), sum(map(str.isupper, words)) / n, min(3.0, text.count("!") / n), min(3.0, text.count("|") / n),
        min(3.0, sum(map(text.count, MARKS)) / n), len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        min(20.0, (len(text) - len(words)) / n),
    ]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def fit(good: list[str], bad: list[str]) -> Model:
    """A classifier over both classes; without rows of one of them it has no evidence to give."""
    x = np.array([features(t) for t in good + bad], dtype=float).reshape(-1, 8)
    if not good or not bad:
        return Model([0.0] * 8, [1.0] * 8, [0.0] * 9, 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    y = np.array([1.0] * len(good) + [0.0] * len(bad))
    w = _logistic(np.hstack([(x - mean) / scale, np.ones((len(x), 1))]), y)
    return Model(mean.tolist(), scale.tolist(), w.tolist(), float(y.mean()))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, held: int = 0) -> Model:
    """A model from at most ``sample`` labelled documents of each class outside fold ``held``, first by a hash of the id."""
    usable = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    usable = usable.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~in_fold(F.col("doc_id"), folds, held))
    order = F.xxhash64("doc_id")
    chosen = usable.filter("quality = 1").orderBy(order, "doc_id").limit(sample).unionByName(usable.filter("quality = 0").orderBy(order, "doc_id").limit(sample))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").collect()  # at most 2 * sample ids
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows if r["quality"]], [r["text"] for r in rows if not r["quality"]])


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def with_evidence(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` with a column (its name is returned): log odds that the text adds to any prior, at most 8 either way."""
    name = free_name(docs, "evidence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, w = np.array(model.mean), np.array(model.scale), np.array(model.weights)
        base = math.log(model.prior / (1 - model.prior))
        for batch in text_slices(batches):
            x = np.array([features(t or "") for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, 8)
            found = np.clip(((x - mean) / scale) @ w[:8] + w[8] - base, -8, 8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def host_of(source: Column) -> Column:
    """The part before the first slash."""
    return F.substring_index(F.coalesce(source.cast("string"), F.lit("")), "/", 1)


def path_of(source: Column, lang: Column) -> Column:
    """The host and its first folder; where sources have none, the host's language section stands for it."""
    s = F.coalesce(source.cast("string"), F.lit(""))
    return F.when(F.instr(s, "/") > 0, F.substring_index(s, "/", 2)).otherwise(F.concat(s, F.lit("/"), F.coalesce(lang.cast("string"), F.lit(""))))


def shrunk(sites: DataFrame, centre: Column) -> DataFrame:
    """``sites`` with ``rate``: good/n pulled to ``centre`` by a prior worth some rows, as the moments of all sites say.

    The spread of good/n around the centre beyond what chance gives is the sites' own; little of it is a strong prior.
    """
    off = (F.col("good") / F.col("n") - centre) ** 2 * F.col("n")
    chance = centre * (1 - centre)
    total, square, spread, noise, mean = sites.agg(
        F.sum("n"), F.sum(F.col("n").cast("double") ** 2), F.sum(off), F.sum(chance), F.sum(chance * F.col("n")) / F.sum("n")
    ).first()
    room = (total - square / total) if total else 0
    own = (spread - noise) / room if room and room > 0 else 0.0
    strength = min(1e4, max(1.0, mean / own - 1)) if own > 1e-9 else 1e4
    return sites.withColumn("rate", (F.col("good") + F.lit(strength) * centre) / (F.col("n") + F.lit(strength)))


def site_rates(evidence: DataFrame, start: float = 0.5) -> DataFrame:
    """(path, rate): each path's posterior share of good rows, shrunk to its host's, and that to the share of all.

    ``evidence`` is (host, path, evidence). A row counts with its own probability of being good at the overall share,
    which three rounds settle. Rows are summed by path before anything moves, so a host with a third of all rows is a
    few rows here; hosts are sums of paths.
    """
    share = start
    for _ in range(3):
        odds = math.log(share / (1 - share))
        total, n = evidence.agg(F.sum(1 / (1 + F.exp(-(F.col("evidence") + odds)))), F.count("*")).first()
        share = min(0.999, max(0.001, total / n)) if n else start
    odds = math.log(share / (1 - share))
    paths = written(evidence.groupBy("host", "path").agg(F.sum(1 / (1 + F.exp(-(F.col("evidence") + odds)))).alias("good"), F.count("*").alias("n")))
    hosts = shrunk(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), F.lit(share))
    around = paths.join(hosts.select("host", F.col("rate").alias("host_rate")), "host")
    rates = shrunk(around, F.col("host_rate"))
    return written(rates.groupBy("path").agg(F.max("rate").alias("rate")))


def judged(rows: DataFrame, rates: DataFrame, evidence: str, path: str, score: str) -> DataFrame:
    """``rows`` with ``score``: the posterior probability of the text's evidence under its path's rate as the prior.

    The rates are broadcast while they are few, as counted; else they are joined by path and a salt, each rate once for
    every salt, so that a path with a third of all rows is dealt out.
    """
    rate, salt = free_name(rows, "rate_"), free_name(rows, "salt_")
    rates = rates.select(F.col("path").alias(path), F.col("rate").alias(rate))
    if rates.count() <= SMALL:
        joined = rows.join(F.broadcast(rates), path, "left")
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id", evidence), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, [path, salt], "left")
    prior = F.coalesce(rate, F.lit(0.5))
    return joined.withColumn(score, 1 / (1 + F.exp(-(F.col(evidence) + F.log(prior / (1 - prior)))))).drop(rate, salt)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, host, path, evidence, score): for every row, the probability that it is good.

    Null and empty texts have the evidence of a text without words; null sources and languages are sites of their own.
    Rows are independent but for the sites' sums, in which repeated rows count each. An empty table gives an empty one.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].alias("lang"), docs["source"].alias("source"))
    made, name = with_evidence(rows, model)
    made = written(made.select("doc_id", host_of(F.col("source")).alias("host"), path_of(F.col("source"), F.col("lang")).alias("path"), F.col(name).alias("evidence")))
    return judged(made, site_rates(made), "evidence", "path", "score")


def filtered(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``. The texts are read twice and not shuffled
    while the site rates are few."""
    made, name = with_evidence(docs.select("doc_id", "text", "lang", "source"), model)
    rates = site_rates(written(made.select(host_of(F.col("source")).alias("host"), path_of(F.col("source"), F.col("lang")).alias("path"), F.col(name).alias("evidence"))))
    rows, name = with_evidence(docs, model)
    path, score = free_name(rows, "path_"), free_name(rows, "score_")
    return judged(rows.withColumn(path, path_of(F.col("source"), F.col("lang"))), rates, name, path, score).filter(F.col(score) >= least).select(*docs.columns)
