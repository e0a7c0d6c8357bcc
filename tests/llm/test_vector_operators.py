"""Vector operators and the component search beside brute force."""

import random

import numpy as np

from clearcase.llm import codes, vectors
from clearcase.llm.components import components


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(500, 500), (None, 3), (3, 4), (4, 3)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 100 for k in range(100, 161)}, **{k: 7 for k in range(7, 40)}, 3: 3, 4: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 150)  # so that full cells are tiled
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 64))
    rows = [*base, *(base[k % 7] * rng.uniform(0.5, 2) + rng.standard_normal(64) * rng.choice([0.05, 0.2, 0.3]) for k in range(500)), *[base[3]] * 150]
    x = np.array(rows, dtype=np.float32)
    ids = rng.permutation(len(x))
    odd = [(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] + [1.0] * 63), (9003, [None] + [1.0] * 63), (9004, [1.0, 2.0]), (9005, [2.0, 4.0]), (9006, [])]
    data = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x)] + odd
    got = {r["vec_id"]: r for r in vectors.linked_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    label, before = ids.copy(), None
    while before is None or (before != label).any():
        before = label
        label = np.array([min(label[i], label[linked[i]].min() if linked[i].any() else label[i]) for i in range(len(x))])
    for k, i in enumerate(ids.tolist()):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (linked[k].sum(), label[k], label[k] == i)
    assert [got[i]["n_links"] for i, _ in odd] == [0, 0, 0, 0, 1, 1, 0] and got[9005]["component_id"] == 9004
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, cell string, n int")
    assert vectors.linked_vectors(empty).count() == 0


def test_nearest_codes_equal_brute_force(spark):
    draw = random.Random(6)
    rows = [(i, draw.getrandbits(64) - (1 << 63)) for i in range(120)] + [(i, 12345) for i in range(120, 160)]
    rows += [(160 + i, 12345 ^ (1 << draw.randrange(60))) for i in range(20)] + [(None, 5), (999, None), (3, rows[3][1])]
    table = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for r in codes.nearest(table, table.filter("id % 20 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["neighbour_id"]))
    known = {i: c for i, c in rows if i is not None and c is not None}
    for q in [i for i in known if i % 20 == 0]:
        want = sorted((((known[q] ^ c) & (2**64 - 1)).bit_count(), i) for i, c in known.items() if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(want)]
    few = spark.createDataFrame([(0, 1), (1, 2)], "id long, code long")
    assert [tuple(r) for r in codes.nearest(few, few.filter("id = 0"), 10).collect()] == [(0, 1, 2, 1)]
    assert codes.nearest(few.limit(0), few.limit(0), 10).count() == 0


def test_sign_codes(spark):
    rows = [(1, [1.0, -1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [])]
    got = {r["id"]: r["code"] for r in codes.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: 5, 2: None, 3: None, 4: None}


def test_linked_vectors_in_rounds(spark, monkeypatch):
    """Copies of vectors that do not fit into one round are made in several, each cell in one of them, with the same links."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 64))
    x = [*base, *(base[k % 50] + rng.standard_normal(64) * 0.2 for k in range(400))]
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, vectors.linked_vectors(df).collect()))
    monkeypatch.setattr(vectors, "CELL", 100)
    monkeypatch.setattr(vectors, "LEAST", 0)
    monkeypatch.setattr(vectors, "ROUND", 2)
    assert sorted(map(tuple, vectors.linked_vectors(df).collect())) == whole
    rounds = vectors.rounds_of({0: 1_000, 1: 300}, 100)
    assert rounds == [(0, k, 3) for k in range(8)] + [(1, k, 1) for k in range(2)] and vectors.rounds_of({0: 150}, 100) == [None]
    y = rng.standard_normal((2_000, 8))
    tree = vectors.divided(y, 100)
    every = sorted((int(n), len(r), int(h.sum())) for r, n, h in vectors.visits(tree, y, 0.1))
    for depth in (0, 3, 9):
        assert sorted((int(n), len(r), int(h.sum())) for part in range(1 << depth) for r, n, h in vectors.visits(tree, y, 0.1, part, depth)) == every
