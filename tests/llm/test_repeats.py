"""Removal of repeated strings beside brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from clearcase.llm import queries, repeats, suffixes


def brute(rows, length):
    """(doc_id, bytes, kept, spans) by counting every string."""
    seen, out = Counter(), []
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = [i for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((d, len(b), bytes(x for x, y in zip(b, gone) if not y), len(spans)))
    return sorted(out, key=str)


def found(rows):
    return sorted([(r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in rows.collect()], key=str)


def made(seed, letters="abcdefgh é"):
    draw = random.Random(seed)
    passages = ["".join(draw.choice(letters) for _ in range(draw.randint(10, 90))) for _ in range(8)]
    rows = [
        (i, "".join(draw.choice(passages) if draw.random() < 0.5 else "".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(draw.randint(0, 7))))
        for i in range(300)
    ]
    return rows + [(None, None), (400, ""), (401, "a" * 500), (402, rows[3][1]), (402, rows[3][1]), (403, "ab" * 200), (404, "x" + "a" * 39)]


@pytest.mark.parametrize("length,group", [(40, 20_000), (40, 3), (7, 2)])
def test_removal_equals_brute_force(spark, monkeypatch, length, group):
    """Also where groups are cut again at longer grams down to the whole string."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    rows = made(length)
    assert found(suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length)) == brute(rows, length)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_columns_equal_comparison_of_all(letters):
    draw = random.Random(len(letters))
    for _ in range(30):
        length, many = 12, draw.randint(1, 60)
        core = "".join(draw.choice(letters) for _ in range(30)).encode()
        groups = np.sort(np.array([draw.randint(0, 4) for _ in range(many)]))
        before, starts, strings = [], [], []
        for _ in range(many):
            low, count = draw.randint(0, 9), draw.randint(1, 9)
            text = bytearray(core[low : low + count + length - 1])
            if draw.random() < 0.6:
                text[draw.randrange(len(text))] = ord(draw.choice(letters))
            strings.append(bytes(text)), before.append(12 - low), starts.append(count)
        flags = repeats.repeated_starts(groups, np.array(before), np.array(starts), strings, length)
        seen = Counter((g, s - b, t[s : s + length]) for g, b, n, t in zip(groups, before, starts, strings) for s in range(n))
        for f, (g, b, n, t) in enumerate(zip(groups, before, starts, strings)):
            assert flags[f, :n].tolist() == [seen[g, s - b, t[s : s + length]] > 1 for s in range(n)]


def test_equal_strings_have_equal_anchors():
    draw = np.random.default_rng(2)
    shared = draw.integers(97, 101, 500, dtype=np.uint8)
    chosen = []
    for _ in range(5):
        text = np.concatenate((draw.integers(97, 101, 300, dtype=np.uint8), shared, draw.integers(97, 101, 200, dtype=np.uint8)))
        at = {}
        for first, count, before, anchor in repeats.anchors(text, 200, 50):
            for a, n, o, h in zip(first, count, before, anchor):
                at |= {s: (a + o - s, h) for s in range(a, a + n)}
        assert sorted(at) == list(range(len(text) - 199))
        chosen.append([at[s] for s in range(300, 601)])
    assert all(c == chosen[0] for c in chosen)


def test_the_query_on_edge_rows(edge, nothing, spark, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_suffixes(spark, str(tmp_path))
    want = Counter((d, n, n - len(k), s) for d, n, k, s in brute([(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()], 400))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows.collect()) == want
    assert suffixes.without_repeats(nothing).count() == 0
