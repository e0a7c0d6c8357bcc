"""Repair of conversations beside plain dynamic programming over all audits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from clearcase.llm import lattice, queries, repair

COLUMNS = "conv_id long, turn long, role string, text string, rank string, segment string, fault string, audit string"


def plain(rows):
    """(cost, audit, [(row, role)]) of one conversation, (initial, fault) by turns: layers of states, whole audits."""
    delta = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}

    def inserted(layer):
        for _ in range(4):
            for q in range(4):
                if q in layer:
                    c, a, out = layer[q]
                    for x in "ua":
                        to = delta.get((q, x))
                        new = (c + 3, a + "I", out + [(-1, names[x])])
                        if to is not None and (to not in layer or new[:2] < layer[to][:2]):
                            layer[to] = new
        return layer

    layer = inserted({0: (0, "", [])})
    for i, (initial, fault) in enumerate(rows):
        after = {}
        extra = 3 * (fault == lattice.CUT_OFF)
        for q, (c, a, out) in layer.items():
            options = [(q, (c + 4, a + "D", out))]
            if fault not in (lattice.BLANK, lattice.DUPLICATE):
                if (q, initial) in delta:
                    options.append((delta[q, initial], (c + extra, a + "K", out + [(i, None)])))
                options += [(delta[q, x], (c + 3 + extra, a + "R", out + [(i, names[x])])) for x in "ua" if (q, x) in delta]
            for to, new in options:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        layer = inserted(after)
    return min((layer[q] for q in (0, 3) if q in layer), key=lambda x: x[:2])


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is None:
            continue
        convs[c]
        role, text = " " if role is None else role, " " if text is None else text
        key = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
        role = "user" if key == 4 else role
        for _ in range(0 if key == 0 else 2 if key == 3 else 1):
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    out = []
    for c, found in convs.items():
        found.sort()
        turns = [t for known, t, *_ in found if known]
        seen, marked = set(), []
        for _, _, digest, role, text in found:
            last = re.sub(r"[\x20\x09-\x0d]+\Z", "", text)[-1:]
            marked.append((role[:1], lattice.BLANK if not last else lattice.DUPLICATE if digest in seen else lattice.CLEAN if last in ".!?" else lattice.CUT_OFF))
            seen.add(digest)
        cost, audit, kept = plain(marked)
        lines = [f"{role or found[i][3]}:{found[i][4] if i >= 0 else ''}" for i, role in kept]
        counts = [sum(f == k for _, f in marked) for k in (lattice.BLANK, lattice.DUPLICATE, lattice.CUT_OFF)]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(rows):
    return sorted(tuple(r[c] for c in NAMES) for r in rows.collect())


def made(seed, convs=120, deepest=14):
    draw = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "User", "tool", None, ""], ["Yes.", "no", "", None, " \t", "Why? \n", "so!", "x.y"]
    rows = []
    for c in range(convs):
        for k in range(draw.randint(1, deepest)):
            turn = None if draw.random() < 0.05 else k + draw.choice([0, 0, 0, 2, -1])
            role = roles[k % 2] if draw.random() < 0.6 else draw.choice(roles)
            rows.append((c, turn, role, draw.choice(texts) if draw.random() < 0.5 else f"turn {c} {k}.", *"xxxx"))
    return rows + rows[:4] + [(None, 1, "user", "lost.", *"xxxx")]


@pytest.mark.parametrize("segment", [1000, 3])
def test_repair_equals_plain_python(spark, monkeypatch, segment):
    """Also where conversations go in segments."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = made(segment)
    assert found(repair.after_damage(spark.createDataFrame(rows, COLUMNS))) == brute(rows)


def test_search_equals_layers():
    draw = random.Random(8)
    for _ in range(4000):
        rows = [(draw.choice("suuaax "), draw.choice([0, 0, 0, 1, 2, 3, 3])) for _ in range(draw.randint(0, 9))]
        found = lattice.cheapest(rows, 0, [4 * len(rows) + s for s in lattice.ENDS], True)
        assert found == plain(rows)[:2], rows
        kept = lattice.replayed([r[0] for r in rows], found[1], 0)
        assert kept == plain(rows)[2]


def test_a_long_conversation_and_the_empty_table(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"turn {k}" + "." * (k % 5), *"xxxx") for k in range(3500)]
    assert found(repair.after_damage(spark.createDataFrame(rows, COLUMNS))) == brute(rows)
    assert repair.after_damage(spark.createDataFrame([], COLUMNS)).count() == 0


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_repair(spark, sf)) == brute(rows)
