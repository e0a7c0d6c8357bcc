"""The registered queries and the pipeline on small tables, beside plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from clearcase.llm import queries

from .conftest import ROWS

WORDS = "the quick brown fox jumps over lazy dogs while small birds sing near quiet rivers and old stone walls under morning light".split()


def docs_of(edge):
    return [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def folder(spark, edge, tmp_path_factory):
    """documents (edge rows, copies, near copies and plain ones), labels and embeddings as the queries read them."""
    draw = random.Random(2)
    path = tmp_path_factory.mktemp("tables")
    texts = [" ".join(draw.choice(WORDS) for _ in range(draw.randint(6, 60))) + "." for _ in range(40)]
    texts += [texts[0], texts[1] + " then", texts[2].upper()]
    columns = edge.columns
    more = spark.createDataFrame([(100 + k, t, "en", f"src{k % 3}", len(t), *["x"] * (len(columns) - 5)) for k, t in enumerate(texts)], edge.schema)
    edge.unionByName(more).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + k, int(k % 4 > 0), int(k % 5 == 0)) for k in range(40)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    points = [[draw.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    points += [[x + draw.gauss(0, 0.02) for x in points[k]] for k in range(10)] + [points[3], [0.0] * 16, None]
    spark.createDataFrame([(k, p, 0) for k, p in enumerate(points)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def texts(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0d]+", lower) if w]


def fold(doc_id, parts):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def test_op1_base_columns(spark, folder, texts):
    train = Counter(w for d, t in texts if fold(d, 7) != 2 for w in [*words(t), None])
    n, v = sum(train.values()), len(train)
    want = Counter()
    for d, t in texts:
        tokens = [*words(t), None]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)
        want[d, fold(d, 7) == 2, len(tokens), sum(train[w] > 0 for w in tokens), n, round(base, 6)] += 1
    rows = queries.op1_scores(spark, folder).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def test_op2_and_op10_scores(spark, folder, texts):
    for query in (queries.op2_quality, queries.op10_toxicity):
        rows = query(spark, folder).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in texts)
        for r in rows:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (fold(r["doc_id"], 5) == 0)


def test_op3_components(spark, folder, texts):
    sets = {}
    for d, t in texts:
        w = words(t)
        found = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.setdefault(d, set()).add(frozenset(found))
    ids = [d for d in sets if d is not None]
    least = {d: d for d in ids}
    links = [(a, b) for a in ids for b in ids if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])]
    for _ in ids:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    rows = queries.op3_near_duplicates(spark, folder).collect()
    assert len(rows) == len(texts) and links
    for r in rows:
        assert r["component_id"] == least.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is not None and r["component_id"] == r["doc_id"])
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    only = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only(m)) <= 19 and luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group())]
    return sorted(found)


def test_op4_base(spark, folder, texts):
    want = Counter()
    for d, t in texts:
        spans = base_spans(t or "")
        joined = ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)
        counts = Counter(name for *_, name in spans)
        want[d, counts["email"], counts["ip"], counts["card"], counts["phone"], hashlib.sha256(joined.encode()).hexdigest()] += 1
    rows = queries.op4_personal_data(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == want


def test_op5_and_op6(spark, folder):
    found = {r["vec_id"]: r for r in queries.op5_vectors(spark, folder).collect()}
    x = np.array([r["embedding"] if r["embedding"] else [0.0] * 16 for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()])
    size = np.linalg.norm(x, axis=1)
    ok = size > 0
    near = np.zeros((len(x), len(x)), bool)
    near[np.ix_(ok, ok)] = (x[ok] @ x[ok].T) / np.outer(size[ok], size[ok]) >= 0.95
    np.fill_diagonal(near, False)
    assert [found[k]["n_links"] for k in range(len(x))] == near.sum(axis=1).tolist() and near.any()
    assert all(r["rank"] <= 10 for r in queries.op6_codes(spark, folder).collect())


def test_op7_shards(spark, folder, texts):
    rows = queries.op7_sharding(spark, folder).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = {}
    for r in rows:
        assert 0 <= r["shard"] < 8 and r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op8_and_op9_tokens(spark, folder, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    ids = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in texts]
    want = Counter((d, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(x, skip_special_tokens=False).encode()).hexdigest()) for d, x in ids)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op9_bpe(spark, folder).collect()) == want
    rows = queries.op8_packing(spark, folder).collect()
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    every = {}
    for d, x in ids:
        every.setdefault(d, []).append([*x, 2])
    total = 0
    for (d, start, length, crc, tokens), n in pieces.items():
        assert any(len(x) == tokens and zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()) == crc for x in every[d])
        total += n * length
    assert total == sum(len(x) for v in every.values() for x in v)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 4096


def test_pipeline_stages(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(r["doc_id"] for r in left.select("doc_id").collect())
        left = corpus_pipeline.written(stage(spark, left, folder))
        assert left.columns == docs.columns, name
        assert not Counter(r["doc_id"] for r in left.select("doc_id").collect()) - before, name
    kept = [r["text"] for r in left.collect()]
    assert kept and not any(base_spans(t or "") for t in kept)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sum(r["length"] for r in packed) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in kept)
    assert len(ROWS) + 43 == len(texts)


def test_pipeline_of_nothing(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
