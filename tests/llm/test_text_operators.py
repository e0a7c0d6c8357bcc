"""Operators on documents beside brute force, on edge cases and on empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clearcase.llm import bpe, lm, near, packing, pii, quality, sharding, toxicity

from .conftest import ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0d]+", lower) if w]


# --- tokens


def test_segment_tree_equals_the_library(tokenizer):
    vocab, packer, draw = bpe.vocabulary(PATH), packing.words(PATH), random.Random(3)
    parts = [*"abAB éÉΣςİ'sS\t\n\r\x0b\x1c\x85\xa0　,.!12½ﬁǺ中🙂ǆＡ", "<|endoftext|>", "I'LL ", "the", "ing", " ", " "]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        ids, decoded = vocab.both(text)
        assert np.frombuffer(ids, np.int32).tolist() == want, text
        assert decoded == tokenizer.decode(want, skip_special_tokens=False), text
        assert np.frombuffer(packer.ids(text), np.int32).tolist() == want, text


def test_merge_order_is_leftmost_lowest():
    merges = {(0, 0): (1, 1), (1, 0): (0, 2)}
    assert bpe.PairRankTree([0, 0, 0], merges).merged() == [2]
    assert bpe.PairRankTree([0] * 4, {(0, 0): (0, 1)}).merged() == [1, 1]
    assert bpe.PairRankTree([0], merges).merged() == [0]


def test_encoding_of_edge_rows(edge, nothing, tokenizer):
    rows = bpe.encoded(edge, PATH).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        texts = [t for d, t, *_ in ROWS if d == r["doc_id"]]
        assert r["ids"] in [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert bpe.encoded(nothing, PATH).count() == 0


# --- packing


def test_first_fit_by_tree_equals_a_scan():
    draw = random.Random(1)
    for _ in range(50):
        sizes = np.array([draw.randint(1, 40) for _ in range(draw.randint(0, 60))], np.int64)
        bins, offsets = packing.first_fit_decreasing(sizes, 40)
        free, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
            if k is None:
                free.append(40)
                k = len(free) - 1
            want[i] = (k, 40 - free[k])
            free[k] -= sizes[i]
        assert {i: (b, o) for i, (b, o) in enumerate(zip(bins.tolist(), offsets.tolist()))} == want


def test_packing_holds_every_id_once(edge, nothing, tokenizer):
    rows = packing.packed(edge, PATH, length=64).collect()
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS)
    assert sum(r["length"] for r in rows) == total
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] * 4 == len(r["ids"])
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(nothing, PATH).count() == 0


# --- sharding


def test_differencing_is_tighter_than_greedy():
    draw = random.Random(5)
    sizes = [draw.randint(1, 10_000) for _ in range(400)]
    sums = [0] * 8
    for size, shard in zip(sizes, sharding.differenced(sizes, 8)):
        sums[shard] += size
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 2
    assert sharding.differenced([], 8) == [] and sorted(sharding.differenced([5, 5, 5], 3)) == [0, 1, 2]


def test_sharding_of_edge_rows(spark, edge, nothing):
    rows = sharding.sharded(edge, 3).collect()
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, *_ in ROWS)
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.sharded(nothing, 3).count() == 0
    # A group of a third of all rows is dealt out; others stay together.
    many = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "hot " * 50).otherwise(F.concat(F.lit("t"), (F.col("id") % 200).cast("string"), F.repeat(F.lit("z"), 150))).alias("text"))
    rows = sharding.sharded(many, 8).join(many, "doc_id").collect()
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.2 * sum(sums.values()) / 8
    cold = {}
    for r in rows:
        if not r["text"].startswith("hot"):
            cold.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in cold.values())


# --- near-duplicates


def components_of(texts):
    sets = {}
    for d, t in texts:
        w = words_of(t)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "LEAF", 6)
    monkeypatch.setattr(near, "GROUP", 20)  # so that groups are cut into blocks
    draw = random.Random(9)
    word = lambda: draw.choice("abcdefgh") + draw.choice("klmnop") + str(draw.randint(0, 30))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(draw.randint(3, 90))]
        for _ in range(draw.randint(1, 25)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of(rows)


def test_near_duplicates_of_edge_rows(edge, nothing):
    rows = near.near_duplicates(edge).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False)
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[5] == (0, 5, True)
    assert got[None][1:] == (None, False) and got[10] == (1, 10, True) and got[11] == (1, 10, False)
    assert near.near_duplicates(nothing).count() == 0


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def base_spans(text):
    found = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[name]
            if fits:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_equal_the_plain_patterns(spark):
    draw = random.Random(2)
    parts = [*"ab1234567890..@- +()_é🙂%", "4111 1111 1111 1111", "1.2.3.4", "255", "a@b.c", "+1 (462) 555-7216", "555 123-4567", "(at)", "[.]"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.personal_data(df).collect()
    for r in rows:
        assert [tuple(s) for s in r["base"]] == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}


@pytest.mark.parametrize("text", ["1 " * 20_000, "a" * 40_000 + "@", "a." * 10_000 + "@b." + "c." * 10_000, "1." * 20_000, "+1" * 20_000, "9" * 40_000])
def test_long_texts_of_the_worst_shape(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(s) for s in pii.personal_data(df).first()["base"]] == base_spans(text)


def test_redaction_keeps_columns_and_rows(edge, nothing):
    rows = pii.redacted(edge, "n_chars")
    assert rows.columns == edge.columns
    got = {r["doc_id"]: r for r in rows.collect()}
    assert got[9]["text"] == "mail [EMAIL] or [CARD], [IP] and 1.2.3.456" and got[9]["n_chars"] == len(got[9]["text"])
    assert got[None]["text"] == "a row without an id, call [PHONE]" and got[1]["text"] == ROWS[0][1]
    assert pii.redacted(nothing).count() == 0 and pii.personal_data(nothing).count() == 0


def test_labelers_are_weighed():
    model = pii.fitted([((1, 1, 1, 1, 1), 900), ((1, -1, -1, 0, -1), 300), ((0, 1, 1, 1, 1), 50), ((0, -1, -1, -1, -1), 50)])
    score = lambda v: model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], v))
    assert score((0, 1, 1, 1, 1)) > 0 > score((0, -1, -1, -1, -1))


# --- classifiers


def test_toxicity_is_learnt(spark, edge, nothing, labels):
    draw = random.Random(4)
    plain = lambda n: [draw.choice("the of and to in that it was for on with".split()) + draw.choice(["", "ing", "ed"]) for _ in range(n)]
    made = []
    for k in range(400):
        w = plain(draw.randint(20, 120))
        if k % 4 == 0:
            for _ in range(3):
                w.insert(draw.randrange(len(w)), draw.choice(["blockhead", "nincompoop", "dunderhead"]))
        made.append((k, " ".join(w), int(k % 4 == 0)))
    docs = spark.createDataFrame([(d, t) for d, t, _ in made], "doc_id long, text string")
    marks = spark.createDataFrame([(d, y) for d, _, y in made], "doc_id long, toxic int")
    found = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, toxicity.trained(docs, marks)).collect()}
    held = [(d, y) for d, _, y in made if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum((found[d] >= 0.5) == bool(y) for d, y in held) >= 0.95 * len(held)
    model = toxicity.trained(edge, labels)
    assert toxicity.scored(edge, model).filter("score BETWEEN 0 AND 1").count() == len(ROWS)
    assert toxicity.filtered(edge, model).columns == edge.columns and toxicity.scored(nothing, model).count() == 0
    assert toxicity.trained(nothing, labels.limit(0)).weights


def test_toxic_thresholds_do_not_follow_the_sample(spark):
    draw = random.Random(8)
    made = []
    for k in range(4000):
        toxic = k % 20 == 0
        w = [draw.choice("the of and to in that it was for on with from when where then".split()) for _ in range(draw.randint(15, 40))]
        # "blockhead" marks toxic texts only; "whatsoever" is in half of them and in one of ten others: 21 % of its texts are toxic.
        if toxic and draw.random() < 0.6:
            w.insert(draw.randrange(len(w)), "blockhead")
        if draw.random() < (0.5 if toxic else 0.1):
            w.insert(draw.randrange(len(w)), "whatsoever")
        made.append((k, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(d, t) for d, t, _ in made], "doc_id long, text string")
    marks = spark.createDataFrame([(d, y) for d, _, y in made], "doc_id long, toxic int")
    model = toxicity.trained(docs, marks, sample=200)
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    weak = [score[d] for d, t, _ in made if "whatsoever" in t and "blockhead" not in t]
    strong = [score[d] for d, t, _ in made if "blockhead" in t]
    assert sum(x >= 0.5 for x in strong) > 0.5 * len(strong) and sum(x >= 0.5 for x in weak) < 0.05 * len(weak)
    assert abs(sum(score.values()) / len(made) - 0.05) < 0.02


def test_toxic_short_words_and_phrases_save_bytes():
    draw = random.Random(9)
    common = "the of and to in that it was for on with from when where then fair low".split()
    plain = lambda: [draw.choice(common) for _ in range(draw.randint(30, 60))]
    ordinary, toxic = [" ".join(plain()).replace("fair low then", "fair then") for _ in range(600)], []
    for k in range(200):
        w = plain()
        w.insert(draw.randrange(len(w)), "zug" if k % 2 else "fair low then")
        toxic.append(" ".join(w))
    gains = toxicity.Gains(toxicity.fit(toxic, ordinary))
    best = lambda insert: sum(gains(" ".join([*plain()[:5], insert, *plain()[:4]]))[0] > 0 for _ in range(50))
    assert best("zug") >= 10 + best("qyx") and best("fair low then") > 10 + best("fair then low")


def test_quality_of_edge_rows(edge, nothing, labels):
    model = quality.trained(edge, labels)
    assert quality.scored(edge, model).filter("score BETWEEN 0 AND 1").count() == len(ROWS)
    assert quality.filtered(edge, model, 0.0).columns == edge.columns and quality.filtered(edge, model, 0.0).count() == len(ROWS)
    assert quality.scored(nothing, model).count() == 0 and quality.filtered(nothing, model).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("a", "a/x", -3.0)] * 200 + [("b", "b/x", 3.0)] * 200 + [("c", "c/x", -3.0)]
    rates = {r["path"]: r["rate"] for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    assert rates["a/x"] < rates["c/x"] < rates["b/x"] and rates["c/x"] - rates["a/x"] > 0.02


# --- scores


def test_scores(spark, edge, nothing):
    rows = lm.scored(edge).collect()
    assert len(rows) == len(ROWS)
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    seen = Counter()
    for d, t, *_ in ROWS:
        if not held(d):
            seen.update([*words_of(t), None])
    n, v = sum(seen.values()), len(seen)
    for r in rows:
        texts = [[*words_of(t), None] for d, t, *_ in ROWS if d == r["doc_id"]]
        want = [(len(t), sum(seen[w] > 0 for w in t), sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in t)) for t in texts]
        assert any((r["n_tokens"], r["n_known"]) == x[:2] and abs(r["base_score"] - x[2]) < 1e-6 * abs(x[2]) for x in want)
        assert r["train_tokens"] == n and r["held_out"] == held(r["doc_id"]) and r["score"] < 0
    assert lm.scored(nothing).count() == 0


def test_scores_know_the_words_before(spark):
    held = [d for d in range(300) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    draw, words = random.Random(6), [f"word{k}" for k in range(50)]
    run = lambda at: " ".join(words[(at + 7 * k) % 50] for k in range(40))
    mixed = run(3).split()
    draw.shuffle(mixed)
    texts = [(d, run(draw.randrange(50))) for d in range(300) if d not in held] + [(held[0], run(3)), (held[1], " ".join(mixed))]
    found = {r["doc_id"]: r["score"] for r in lm.scored(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[held[0]] > found[held[1]] / 4


def test_bits_of_words_equal_a_plain_mixer():
    """Held-out tokens by dictionaries of counts; the codes of all words sum to one after any context."""
    draw, n = random.Random(7), 12
    hashes = np.array([draw.getrandbits(63) for _ in range(n + 1)], np.uint64)
    c = np.array([9 - k // 2 for k in range(n)] + [40])
    code = np.array([((32 | (1 + k // 4)) << 2) | k % 4 for k in range(n)] + [(32 | 5) << 0])
    rank = np.empty(n + 1, np.int64)
    rank[np.lexsort((hashes, c))] = np.arange(n + 1)
    texts = [[draw.choice([0, 1, 2, draw.randrange(n)]) for _ in range(draw.randint(0, 9))] for _ in range(60)]
    codes, doc, place = lm.tokens_of([np.array(t, np.int32).tobytes() for t in texts], n)
    before, held = lm.word_contexts(codes, doc, place, hashes, rank), doc % 5 == 0
    again, odds = np.ones((3, len(codes)), bool), lm.class_odds({1: 50, 2: 30, 3: 20, 5: 60})
    model, none = lm.Mixer.empty(odds), np.zeros(len(codes), bool)
    model.count(code[codes[~held]], before[:, ~held], again[:, ~held], none[~held], none[~held])
    found = model.log_probability(code[codes], before, again, none, model.refined())

    def contexts(t, k):
        return [max(t[:k], key=lambda w: rank[w], default=None), (t[k - 1] if k else None,), tuple(t[max(0, k - 2) : k])]

    tally = Counter()
    for d, t in enumerate(texts):
        if d % 5:
            for k, w in enumerate([*t, n]):
                bits = f"{code[w]:b}"
                tally.update((j, x, bits[:i], bits[i]) for i in range(1, len(bits)) for j, x in enumerate(contexts(t, k)))

    def plain(t, k, w):
        bits, total = f"{code[w]:b}", 0.0
        for i in range(1, len(bits)):
            x = [odds[int(bits[:i], 2)] if i <= lm.CLASS_BITS else 0.0]
            x += [math.log((tally[j, y, bits[:i], "1"] + lm.DELTA) / (tally[j, y, bits[:i], "0"] + lm.DELTA)) for j, y in enumerate(contexts(t, k))]
            y = min(12, max(-12, 0.4 * sum(x)))
            grid = round((y + 12) * (lm.BUCKETS - 1) / 24) * 24 / (lm.BUCKETS - 1) - 12
            p = (1 / (1 + math.exp(-y)) + 1 / (1 + math.exp(-grid))) / 2
            total += math.log(p if bits[i] == "1" else 1 - p)
        return total

    want = [plain(t, k, w) for t in texts for k, w in enumerate([*t, n])]
    assert np.allclose(found, want, atol=1e-4)
    classes = [c for c in range(32)]
    every = [(32 | c) << 2 | k for c in classes for k in range(4)]
    at = np.full(len(every), 7)
    p = model.log_probability(np.array(every), before[:, at], again[:, at], none[at], model.refined())
    assert abs(np.exp(p).sum() - 1) < 1e-4


def test_copies_meet_in_a_chunk_and_bits_are_returned(spark):
    draw = random.Random(8)
    new = lambda: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 12))) for _ in range(120))
    held = [d for d in range(400) if zlib.crc32(str(d).encode()) % 7 == 2]
    texts = {d: new() for d in range(400)}
    taught = [d for d in range(400) if d not in held]
    for k in range(0, 60, 2):  # trust in longer contexts is learnt from copies among training texts
        texts[taught[k]] = texts[taught[k + 1]]
    texts[held[0]] = texts[taught[-1]]
    rows = {r["doc_id"]: r for r in lm.scored(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert rows[held[0]]["score"] > rows[held[1]]["score"] / 3
    for d, r in rows.items():
        assert r["n_bytes"] == len(texts[d]) and abs(r["bits"] + r["score"] * math.log2(10)) < 1e-6 * r["bits"]


def test_long_unseen_words_cost_by_their_length(spark):
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    draw = random.Random(5)
    blob = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(8000))
    texts = [(d, "some plain words of a text") for d in range(200) if d not in held] + [(held[0], blob[:4000]), (held[1], blob)]
    found = {r["doc_id"]: r["score"] for r in lm.scored(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[held[0]] < -1000 and abs(found[held[1]] / found[held[0]] - 2) < 0.1


def test_spelling_is_a_distribution(spark):
    words = spark.createDataFrame([(w,) for w in ("ab", "abc", "ba", "bb", "c")], "word string")
    model = lm.trained(words)
    # All first bytes together: the probability that a word begins with each, by its bits.
    total = 0.0
    for byte in range(256):
        data, place = np.array([byte], np.uint64), np.zeros(1, np.int64)
        p = 1.0
        for b, bit, slots in lm.bit_steps(data, place):
            z = np.stack([model.zeros[k][slots[k]] for k in range(len(lm.ORDERS))])
            o = np.stack([model.ones[k][slots[k]] for k in range(len(lm.ORDERS))])
            gate = ((z + o) > 0).sum(axis=0) * 8 + b
            y = lm.mixed(lm.stretched(z, o), gate, model.weights)
            q = float(((lm.squash(y) + model.refine[gate, lm.bucket(y)]) / 2)[0])
            p *= q if bit[0] else 1 - q
        total += p
    assert abs(total - 1) < 1e-9




def test_candidates_of_one_long_text_cost_in_proportion(spark):
    """64,000 numbers in one row cost at most 20 times 4,000, and offsets and contexts are those of plain Python."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "12;" * n)], "doc_id long, text string").repartition(1)
        start = time.time()
        assert pii.candidates(df).select(F.size("found")).first()[0] == n
        return time.time() - start

    seconds(10)
    assert seconds(64_000) < 20 * max(seconds(4000), 1.0)
    text = "é中🙂 " * 70 + "mail ann.lee@mail.example.com now " + "x" * 200 + " call +1 (462) 555-7216 or card 4111 1111 1111 1111"
    found = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["found"]
    spans = {(pii.KINDS[c["kind"]], text[c["s"] : c["e"]], c["cue"]) for c in found if c["check"] == 1}
    assert {("email", "ann.lee@mail.example.com", 1), ("phone", "+1 (462) 555-7216", 1), ("card", "4111 1111 1111 1111", 1)} <= spans


def test_repeated_rows_spread_over_packing_groups(spark):
    rows = [(1, "the same row again")] * 4000 + [(k, f"row number {k}") for k in range(2, 4002)]
    placed = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH).groupBy((F.col("sequence_id") / (1 << 32)).cast("int")).count().collect()
    sizes = [r["count"] for r in placed]
    assert sum(sizes) == len(rows) and len(sizes) == 4 and max(sizes) < 1.2 * len(rows) / 4


def test_packing_keeps_few_and_short_words(tokenizer):
    known = packing.Words(PATH, 50)
    for k in range(200):
        known.ids(f"word{k} " + "z" * 5000)
        assert len(known) <= 50 and max(map(len, known)) <= packing.MEMO_WORD
    for text in ("word3 word3 " + "ab" * 400 + " end", "one two three"):
        assert np.frombuffer(known.ids(text), np.int32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
