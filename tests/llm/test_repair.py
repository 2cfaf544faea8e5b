"""Repair of conversations against a plain search."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from meterlake.llm import conversation_repair, turn_edits
from meterlake.llm.conversation_repair import audited_repairs, damaged_turns, plan_repairs, repaired_turns

LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, block string, kind string"


def cheapest(turns):
    """Least (cost, letters, repaired) by trying every edit of every turn; ``turns``: (role, text, fault)."""
    best = {"": (0, "", ())}

    def inserted(found):
        for _ in range(2):
            for said, (cost, letters, kept) in list(found.items()):
                for role in ("user", "assistant"):
                    consider(found, said + role[0], (cost + 2, letters + "I", (*kept, (role, ""))))
        return found

    def consider(found, said, way):
        said = re.sub("^s?(ua)+", "ua", said)  # what may follow depends on no more
        if LEGAL.fullmatch(said) or LEGAL.fullmatch(said + "a") or LEGAL.fullmatch(said + "ua"):
            found[said] = min(found.get(said, way), way)

    for role, text, fault in turns:
        after = {}
        for said, (cost, letters, kept) in inserted(best).items():
            consider(after, said, (cost + 3, letters + "D", kept))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                consider(after, said + (role[:1] or "?"), (cost + more, letters + "K", (*kept, (role, text))))
                for other in ("user", "assistant"):
                    consider(after, said + other[0], (cost + 2 + more, letters + "R", (*kept, (other, text))))
        best = after
    return min(way for said, way in inserted(best).items() if LEGAL.fullmatch(said))


def faults(turns):
    seen, told = set(), []
    for role, text in turns:
        bare = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        told.append((role, text, fault))
    return told


def audit(rows):
    """The contract's row of one conversation from its turns (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    told = faults([r[1:] for r in rows])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda f: sum(x[2] == f for x in told)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
    cost, letters, kept = cheapest(told)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, letters, digest


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        for _ in range({0: 0, 3: 2}.get(fault, 1)):
            yield conv, turn, "user" if fault == 4 else role, text


def conversations():
    r = random.Random(4)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "unknown", "User", None]
    texts = ["Yes.", "Yes.", "no", "What?", " \x0b\n", "", "é!", "so. \t", None, "A longer answer.", "x "]
    rows = [(c, r.choice([t, t, t, t * 3, None]), r.choice(roles), r.choice(texts)) for c in range(120) for t in range(r.randint(1, 9))]
    rows += [(500, t, ("user", "assistant")[t % 2], f"Turn {t}{r.choice(['.', '', '!'])}") for t in range(400) if r.random() < 0.9]
    rows += [(None, t, r.choice(roles), r.choice(texts)) for t in range(6)] + [(None, 2, "user", "Yes.")] * 3
    rows += [(501, 1, "system", "long. " * 50_000), (501, 2, "user", "Yes."), (501, 3, "assistant", "y" * 300_000)]
    gone = next(c for c in range(600, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "Only this.")], gone


@pytest.mark.parametrize("block_bits", [16, 2])
def test_audits(spark, monkeypatch, block_bits):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", block_bits)
    rows, gone = conversations()
    table = spark.createDataFrame([(*x, "b", "k") for x in rows], SCHEMA).repartition(3)
    got = audited_repairs(table, damaged_turns(table)).collect()
    hurt = list(damaged(rows))
    want = {c: audit([x[1:] for x in hurt if x[0] == c]) for c in {x[0] for x in rows}}
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert {c for w in want.values() for c in w[6]} == set("DIKR")


def test_repaired_turns_are_those_of_the_audit(spark):
    rows, _ = conversations()
    table = spark.createDataFrame([(*x, "b", "k") for x in rows], SCHEMA)
    own = {}
    for x in sorted(repaired_turns(plan_repairs(table)).collect(), key=lambda x: (x.block, x.number)):
        own.setdefault(x.conv_id, []).append((x.edit, x.role, x.text))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv, found in own.items():
        want = audit([x[1:] for x in plain if x[0] == conv])
        assert "".join(e for e, _, _ in found) == want[6]
        assert LEGAL.fullmatch("".join(r[:1] for e, r, _ in found if e != "D"))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for e, r, t in found if e != "D").encode()).hexdigest() == want[7]


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert audited_repairs(none, damaged_turns(none)).count() == 0


@pytest.mark.parametrize("cut", [1, 2, 3])
def test_blocks_give_what_one_block_gives(cut):
    for kinds in map("".join, product("sUa2x", repeat=4)):
        cost, (before,), (after,) = turn_edits.chained([turn_edits.through(kinds)])
        whole = turn_edits.edits(kinds, before, after, cost, True)
        parts = [kinds[:cut], kinds[cut:]]
        total, befores, afters = turn_edits.chained([turn_edits.through(p) for p in parts])
        assert total == cost
        state, letters = turn_edits.START, ""
        for k, part in enumerate(parts):
            _, state, more = next(e for e in turn_edits.edits(part, befores[k], afters[k], total, k == 1) if e[0] == state)
            letters += more
        assert letters == next(e[2] for e in whole if e[0] == turn_edits.START)
