"""The prefix trie beside plain Python and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from clearcase.llm import queries, trie

COLUMNS = "conv_id long, turn long, role string, text string, node string, comp string, weight string, leaf string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    words = lambda t: len([w for w in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w])
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(m) - 1) * (words(n[-1][1]) if n else 0)
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else -1, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, m in members.items()
    )


def found(rows):
    return sorted(
        (r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
        for r in rows.collect()
    )


def made(seed, convs=60, deepest=9):
    draw = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = draw.randint(0, 90)
        for k in range(draw.randint(1, deepest)):
            rows.append((c, None if draw.random() < 0.03 else k, draw.choice(["user", "assistant", None]), draw.choice(["a b", "c", "", None, "d\te f"]), *"xxxx"))
    rows += [(7, k, "user", f"long {k % 3}", *"xxxx") for k in range(80)]
    return rows + rows[:3] + [(None, 1, "user", "lost", *"xxxx")]


@pytest.mark.parametrize("component,block", [(20_000, 1024), (12, 5)])
def test_trie_equals_plain_python(spark, monkeypatch, component, block):
    """Also where components are split by Spark, and depths are added up in many blocks."""
    monkeypatch.setattr(trie, "COMPONENT", component)
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = made(component)
    assert found(trie.prefix_trie(spark.createDataFrame(rows, COLUMNS))) == brute(rows)


def test_long_lists_of_ends_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "ENDS_CHUNK", 5)
    rows = [(c, 0, "user", "same", *"xxxx") for c in range(300)]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, COLUMNS))) == brute(rows)


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], COLUMNS)).count() == 0


def test_centroids_of_any_tree():
    draw = random.Random(4)
    for _ in range(60):
        n = draw.randint(1, 80)
        parent = np.array([-1] + [draw.randint(max(0, v - draw.choice([1, 3, 80])), v - 1) for v in range(1, n)])
        values = np.array([[draw.randint(0, 5), draw.randint(0, 5)] for _ in range(n)])
        weight, want = np.array([draw.randint(1, 4) for _ in range(n)]), values.copy()
        for v in range(n - 1, 0, -1):
            want[parent[v]] += want[v]
            weight[parent[v]] += weight[v]
        assert np.array_equal(trie.split_component(parent, weight, values), want)


def test_query_and_sql_on_the_table(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(tuple(-1 if x is None else x for x in r) for r in db.execute(queries.TRIE_SQL).fetchall())
    assert found(queries.op11_trie(spark, sf)) == want
