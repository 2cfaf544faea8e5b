"""The cheapest edits that make a run of turns alternate: a graph of (turns used up, state) and its tight arcs.

Roles by their initials must read ``(s?(ua)+)?``. A turn is a kind: its initial (x: any other role), upper
case if its text is cut off, a digit in place of s, u, a, x if it has to go.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

#: Nothing yet; after system; after user; after assistant.
STATES = range(4)
START, ENDS = 0, (0, 3)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state after a turn whose role can be chosen, and with it that role.
CHOSEN = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
KINDS, DOOMED = "suaxSUAX1234", "1234"
INITIALS = str.maketrans("SUAX1234", "suaxsuax")
LEGAL = {"su", "ua", "au"}
INSERT, FAR = 2, 1 << 40
SHORT = 64


def arcs_of(kind: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of each edit that uses up a turn of this kind."""
    yield "D", 3, state
    if kind not in DOOMED:
        cut_off = int(kind.isupper())
        if kind.lower() in KEPT[state]:
            yield "K", cut_off, KEPT[state][kind.lower()]
        yield "R", 2 + cut_off, CHOSEN[state]


ARCS = {kind: [list(arcs_of(kind, s)) for s in STATES] for kind in KINDS}


def with_inserts(costs: Sequence[int]) -> list[int]:
    """Least costs from the start once turns may be inserted; three rounds reach all states."""
    costs = list(costs)
    for _ in range(3):
        for s in STATES:
            costs[CHOSEN[s]] = min(costs[CHOSEN[s]], costs[s] + INSERT)
    return costs


def before_inserts(costs: Sequence[int]) -> list[int]:
    """Least costs to the end once turns may be inserted."""
    costs = list(costs)
    for _ in range(3):
        for s in STATES:
            costs[s] = min(costs[s], costs[CHOSEN[s]] + INSERT)
    return costs


def forward(kinds: str, entry: Sequence[int]) -> list[list[int]]:
    """Least cost of each state after each turn; ``entry`` are the costs before the first."""
    layers = [list(entry)]
    for kind in kinds:
        reached = [FAR] * 4
        for s in STATES:
            for _, cost, to in ARCS[kind][s]:
                reached[to] = min(reached[to], layers[-1][s] + cost)
        layers.append(with_inserts(reached))
    return layers


def backward(kinds: str, exit_: Sequence[int]) -> list[list[int]]:
    """Least cost to the end from each state before each turn; ``exit_`` are the costs after the last."""
    layers = [list(exit_)]
    for kind in reversed(kinds):
        layers.append(before_inserts([min(cost + layers[-1][to] for _, cost, to in ARCS[kind][s]) for s in STATES]))
    return layers[::-1]


def _through(kinds: str) -> list[list[int]]:
    return [forward(kinds, [0 if s == t else FAR for t in STATES])[-1] for s in STATES]


_known_through = lru_cache(1 << 14)(_through)


def through(kinds: str) -> list[list[int]]:
    """Least cost of each state after the block from each state before it."""
    return _known_through(kinds) if len(kinds) <= SHORT else _through(kinds)


def chained(blocks: Sequence[Sequence[Sequence[int]]]) -> tuple[int, list[list[int]], list[list[int]]]:
    """From the matrices of a conversation's blocks: the least cost of all, and for each block the costs
    from the start to its states before it, and from its states after it to the end."""
    befores = [with_inserts([0 if s == START else FAR for s in STATES])]
    for m in blocks:
        befores.append([min(befores[-1][s] + m[s][t] for s in STATES) for t in STATES])
    afters = [before_inserts([0 if s in ENDS else FAR for s in STATES])]
    for m in reversed(blocks):
        afters.append(before_inserts([min(m[s][t] + afters[-1][t] for t in STATES) for s in STATES]))
    return afters[-1][START], befores[:-1], afters[::-1][1:]


def _edits(kinds: str, before: tuple[int, ...], after: tuple[int, ...], total: int, last: bool) -> list[tuple[int, int, str]]:
    costs, rest = forward(kinds, before), backward(kinds, after)
    found = []
    for entry in STATES:
        if costs[0][entry] + rest[0][entry] != total:
            continue
        at, frontier, letters = 0, {entry}, []
        while at < len(kinds) or (last and not any(costs[at][s] == total for s in frontier if s in ENDS)):
            tight: dict[str, set[int]] = {}
            for s in frontier:
                if costs[at][s] + INSERT + rest[at][CHOSEN[s]] == total:
                    tight.setdefault("I", set()).add(CHOSEN[s])
                for letter, cost, to in ARCS[kinds[at]][s] if at < len(kinds) else ():
                    if costs[at][s] + cost + rest[at + 1][to] == total:
                        tight.setdefault(letter, set()).add(to)
            letter = min(tight)
            letters.append(letter)
            frontier = tight[letter]
            at += letter != "I"
        found.append((entry, min(frontier), "".join(letters)))
    return found


_known_edits = lru_cache(1 << 14)(_edits)


def edits(kinds: str, before: Sequence[int], after: Sequence[int], total: int, last: bool) -> list[tuple[int, int, str]]:
    """State before, state after and letters of the least optimal edits of a block, for each state before it
    that an optimal path passes.

    An arc is tight if the least cost to its start, its own and the least cost from its end add up to the
    total. From the set of states that the letters so far lead to, the least letter of a tight arc is taken.
    Turns inserted after the block belong to the next one, or to the block if it is the last.
    """
    return (_known_edits if len(kinds) <= SHORT else _edits)(kinds, tuple(before), tuple(after), total, last)


def illegal_pairs(kinds: str) -> int:
    initials = kinds.translate(INITIALS)
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def step(state: int, letter: str, initial: str) -> int:
    """The state after an edit."""
    return state if letter == "D" else KEPT[state][initial] if letter == "K" else CHOSEN[state]
