"""The edit lattice of a conversation and its bidirectional search.

A place is (rows used, state) as one number, ``4 * used + state``. States follow the role initials given so far: nothing
yet, a system turn, a user turn, an assistant turn. Edits are letters: D(elete), I(nsert), K(eep), R(erole).
"""

from __future__ import annotations

from heapq import heappop, heappush

#: Costs of the edits, and of a truncated turn that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Turns that must go, and those that are cut off.
CLEAN, BLANK, DUPLICATE, CUT_OFF = 0, 1, 2, 3
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The only state that an inserted or reroled turn leads to.
GIVEN = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
ENDS = (0, 3)

Row = tuple[str, int]  # role initial, fault


def ahead(rows: list[Row], place: int, open_end: bool) -> list[tuple[str, int, int]]:
    """(letter, cost, place) of the edits at a place, in the order of their letters."""
    used, state = divmod(place, 4)
    found = []
    if used < len(rows):
        initial, fault = rows[used]
        found.append(("D", DELETE, place + 4))
        found.append(("I", INSERT, 4 * used + GIVEN[state]))
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED * (fault == CUT_OFF)
            if initial in NEXT[state]:
                found.append(("K", extra, 4 * used + 4 + NEXT[state][initial]))
            found.append(("R", REROLE + extra, 4 * used + 4 + GIVEN[state]))
    elif open_end:
        found.append(("I", INSERT, 4 * used + GIVEN[state]))
    return found


def behind(rows: list[Row], place: int, open_end: bool) -> list[tuple[int, int]]:
    """(cost, place) of the edits that lead to a place."""
    used, state = divmod(place, 4)
    found = []
    if used < len(rows) or open_end:
        found += [(INSERT, 4 * used + q) for q in range(4) if GIVEN[q] == state]
    if used:
        initial, fault = rows[used - 1]
        found.append((DELETE, place - 4))
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED * (fault == CUT_OFF)
            found += [(extra, 4 * used - 4 + q) for q in range(4) if NEXT[q].get(initial) == state]
            found += [(REROLE + extra, 4 * used - 4 + q) for q in range(4) if GIVEN[q] == state]
    return found


def _settle(heap: list, known: dict[int, int]) -> int | None:
    """The next place of a search, with its final cost in ``known``."""
    while heap:
        cost, place = heappop(heap)
        if place not in known:
            known[place] = cost
            return place
    return None


def cheapest(rows: list[Row], start: int, goals: list[int], open_end: bool) -> tuple[int, str] | None:
    """The least cost from ``start`` to a goal, and the ASCII-least audit of that cost; None where no edits lead there.

    Two Dijkstra searches run from both ends, the one with the nearer next place first, until no crossing of the least
    cost can be left. A crossing is an edit from a place that the first has settled to one that the second has. Places
    on cheapest ways are then marked back from all crossings, and the audit takes the least letter that stays on one: it
    is the least of all concatenations, for of two audits that lead from one place to another at one cost neither begins
    with the other.
    """
    first: dict[int, int] = {}
    second: dict[int, int] = {}
    out, back = [(0, start)], [(0, g) for g in goals]
    best = None
    crossings: list[tuple[int, int]] = []  # (cost, place settled first)
    while True:
        while out and out[0][1] in first:
            heappop(out)
        while back and back[0][1] in second:
            heappop(back)
        if not (out or back) or (best is not None and (out[0][0] if out else best + 1) + (back[0][0] if back else best + 1) > best):
            break
        if out and (not back or out[0][0] < back[0][0]):  # the goals are settled before anything else
            place = _settle(out, first)
            for _, cost, to in ahead(rows, place, open_end):
                if to in second:
                    crossings.append((first[place] + cost + second[to], place))
                if to not in first:
                    heappush(out, (first[place] + cost, to))
            if place in second:
                crossings.append((first[place] + second[place], place))
        else:
            place = _settle(back, second)
            for cost, to in behind(rows, place, open_end):
                if to in first:
                    crossings.append((first[to] + cost + second[place], to))
                if to not in second:
                    heappush(back, (second[place] + cost, to))
            if place in first:
                crossings.append((first[place] + second[place], place))
        if crossings:
            best = min(c for c, _ in crossings) if best is None else min(best, min(c for c, _ in crossings[-12:]))
    if best is None:
        return None
    good = {p for c, p in crossings if c == best}
    pile = list(good)
    while pile:
        place = pile.pop()
        for cost, to in behind(rows, place, open_end):
            if to not in good and to in first and first[to] + cost == first[place]:
                good.add(to)
                pile.append(to)
    audit, place, spent = [], start, 0
    ends = set(goals)
    while not (place in ends and spent == best):
        for letter, cost, to in ahead(rows, place, open_end):
            if (second[to] == best - spent - cost) if to in second else (to in good and first[to] == spent + cost):
                audit.append(letter)
                place, spent = to, spent + cost
                break
    return best, "".join(audit)


def replayed(initials: list[str], audit: str, state: int) -> list[tuple[int, str | None]]:
    """(row or -1 for an inserted turn, new role or None) of the turns that an audit leaves."""
    used, found = 0, []
    for letter in audit:
        if letter == "D":
            used += 1
            continue
        state = NEXT[state][initials[used]] if letter == "K" else GIVEN[state]
        found.append((-1 if letter == "I" else used, None if letter == "K" else ROLES[state]))
        used += letter != "I"
    return found
