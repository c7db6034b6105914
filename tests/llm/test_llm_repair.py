"""Conversation repair against exhaustive edits and a plain dynamic programme."""

import itertools
import random
import re
import zlib
from hashlib import sha256

from docflow.llm import repair

ROWS = "conv_id long, turn long, role string, text string, key string, rank string, audit int"
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
SPACE = " \t\n\x0b\x0c\r"


def _faults(rows):
    """rows: (role, text) in order."""
    out = []
    for i, (role, text) in enumerate(rows):
        bare = text.rstrip(SPACE)
        out.append("b" if not bare else "d" if (role, text) in rows[:i] else "t" if bare[-1] not in ".!?" else "-")
    return out


def _exhaustive(rows):
    """The cheapest (cost, audit, lines) over all edits with at most two insertions in one place."""
    faults, best = _faults(rows), None
    slots = [["", "I", "II"]] * (len(rows) + 1)
    for letters in itertools.product("DKR", repeat=len(rows)):
        if any(f in "bd" and x != "D" for f, x in zip(faults, letters, strict=True)):
            continue
        for gaps in itertools.product(*slots):
            audit = "".join(g + x for g, x in zip(gaps, (*letters, ""), strict=True))
            cost = sum(COSTS[x] for x in audit) + sum(f == "t" and x != "D" for f, x in zip(faults, letters, strict=True))
            if best and (cost, audit) >= best[:2]:
                continue
            free = audit.count("I") + audit.count("R")
            for roles in itertools.product(("user", "assistant"), repeat=free):
                given, said, at = iter(roles), [], 0
                for x in audit:
                    if x == "I":
                        said.append((next(given), ""))
                        continue
                    role, text = rows[at]
                    at += 1
                    if x != "D":
                        said.append((role if x == "K" else next(given), text))
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in said)):
                    best = (cost, audit, said)
                    break
    return best


def _plain(rows):
    """The same by the best prefix of each state, row by row."""
    to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    names = {"u": "user", "a": "assistant"}
    after = lambda s: "a" if s == "u" else "u"
    states = {"": (0, "", ())}

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for s, (c, a, said) in list(out.items()):
                new = (c + 2, a + "I", (*said, (names[after(s)], "")))
                if after(s) not in out or new[:2] < out[after(s)][:2]:
                    out[after(s)] = new
        return out

    for (role, text), fault in zip(rows, _faults(rows), strict=True):
        new = {}
        for s, (c, a, said) in inserted(states).items():
            moves = [(s, c + 3, "D", ())]
            if fault not in "bd":
                late = int(fault == "t")
                moves.append((after(s), c + 2 + late, "R", ((names[after(s)], text),)))
                if not role:
                    moves.append((s, c + late, "K", ((role, text),)))
                elif (s, role[0]) in to:
                    moves.append((to[s, role[0]], c + late, "K", ((role, text),)))
            for t, cost, x, more in moves:
                if t not in new or (cost, a + x) < new[t][:2]:
                    new[t] = (cost, a + x, (*said, *more))
        states = new
    return min((v for s, v in inserted(states).items() if s in ("", "a")), key=lambda v: v[:2])


def _texts(r):
    return r.choice(["Yes.", "no", "", " \n", "Is it? ", "same.", "same.", "é!"])


def _rows(r, n):
    return [(r.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "u", "Assistant", " "]), _texts(r)) for _ in range(n)]


def _codes(rows):
    return "".join(("e" if not role else role[0] if role[0] in "sua" else "x") + f for (role, _), f in zip(rows, _faults(rows), strict=True))


def test_search_is_exact():
    r = random.Random(1)
    for n in (0, 1, 1, 2, 2, 3, 3, 3, 3):
        for _ in range(6):
            rows = _rows(r, n)
            cost, audit, _ = want = _exhaustive(rows)
            assert repair.solve(_codes(rows))[repair.END] == (cost, audit)
            assert _plain(rows)[:2] == want[:2]


def test_blocks_fold_to_the_whole():
    r = random.Random(2)
    for n in (5, 20, 60):
        for _ in range(25):
            rows = _rows(r, n)
            codes, fold, size = _codes(rows), repair.Fold(), r.choice([1, 2, 7])
            for at in range(0, n, size):
                entries = (0,) if not at else range(4)
                ways = [{"from": e, "to": t, "cost": c, "audit": a} for e in entries for t, (c, a) in repair.solve(codes[2 * at : 2 * (at + size)], e, at + size >= n).items()]
                fold.add(codes[2 * at : 2 * (at + size)], ways)
            counts, audit = fold.result()
            want = _plain(rows)
            assert (counts["cost"], audit) == want[:2] == repair.solve(codes)[repair.END]


def _expected(rows):
    """rows: (conv, turn, role, text) of one conversation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    said, turns = [x[1:] for x in rows], {t for t, _, _ in rows if t is not None}
    faults = _faults(said)
    cost, audit, out = _plain(said)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest())


def test_repair(spark, monkeypatch):
    r = random.Random(3)
    rows = []
    for conv in [*range(40), None]:
        for role, text in _rows(r, r.choice([1, 2, 5, 9, 30])):
            rows.append((conv, r.choice([None, *range(12)]), r.choice([role, role, None]), r.choice([text, text, None, "long text " * 9000])))
    rows += [(77, None, None, None), *[(78, 1, "user", "same?")] * 4, (79, 5, "assistant", "x."), (79, 9, "user", "y.")]
    table = spark.createDataFrame([(*x, "clash", "clash", 1) for x in rows], ROWS)
    want = {}
    for conv in {x[0] for x in rows}:
        want["" if conv is None else f"={conv}"] = _expected([x for x in rows if x[0] == conv])
    for block in (repair.BLOCK, 4):
        monkeypatch.setattr(repair, "BLOCK", block)
        got = {x[0]: tuple(x[1:]) for x in repair.repair(table).select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
        assert got == want
    assert repair.repair(table.where("false")).count() == 0


def test_damage(spark):
    rows = [(c, t, r, x) for c in [*range(30), None] for t in [*range(6), None] for r, x in [("assistant", "Why? Yes. So!"), (None, None)]]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = [tuple(x) for x in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
