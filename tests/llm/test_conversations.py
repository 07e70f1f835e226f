import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np

from millrace.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """A row of each conversation, by recursion over turns and states."""
    by: dict = {}
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        here = by.setdefault(conv, [])
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", s(text)) if kind == 2 else s(text)
            here += [(turn, "user" if kind == 4 else s(role), x)] * (2 if kind == 3 else 1)
    return [one(conv, here) for conv, here in by.items()]


def one(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    first = [r[:1] for _, r, _ in rows]
    n = len(rows)
    ok = lambda roles: re.fullmatch("(s?(ua)+)?", "".join(roles)) is not None
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    want = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, inserts=0):
        out = [(0, "")] if i == n and state in ("", "a") else []
        if inserts < 2:
            c, e = best(i, want[state], inserts + 1)
            out.append((c + 2, "I" + e))
        if i < n:
            more = 1 if faults[i] == "truncated" else 0
            c, e = best(i + 1, state)
            out.append((c + 3, "D" + e))
            if faults[i] not in ("blank", "duplicate"):
                if (state, first[i]) in step:
                    c, e = best(i + 1, step[state, first[i]])
                    out.append((c + more, "K" + e))
                c, e = best(i + 1, want[state])
                out.append((c + 2 + more, "R" + e))
        return min(out, default=(10**9, ""))

    cost, audit = best(0, "")
    made, i = [], 0
    for e in audit:
        last = made[-1][0][:1] if made else ""
        due = {"u": "user", "a": "assistant"}[want[last]]
        if e == "I":
            made.append((due, ""))
        else:
            if e != "D":
                made.append((due if e == "R" else rows[i][1], rows[i][2]))
            i += 1
    assert ok([r[:1] for r, _ in made]) and i == n
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, edits string")
    return sorted((tuple(r) for r in C.repaired_conversations(C.damaged(df)).collect()), key=str)


def test_equal_to_recursion(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(400):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            if rng.random() < 0.08:
                role = rng.choice(["system", "tool", "", None, "s", "Übung"])
            text = rng.choice(["Yes.", "No!", "Why?", "So it", "", " \n", None, "a.\t", "b", "c. d", "«é»", "x.y \x0b"])
            if text and rng.random() < 0.3:
                text += str(turn)
            rows.append((conv, turn if rng.random() < 0.97 else None, role, text))
    rows = list({r[:2]: r for r in rows}.values())  # ties between different texts have a test of their own
    rows += [(None, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(7)]
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_real_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_odd_conversations(spark):
    """All rows lost, long ones over many batches, repeated rows, equal turns, no rows."""
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    long = [(5000, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(12_000)]
    got = {r[0]: r for r in run(spark, [(lost, 0, "user", "x."), *long])}
    assert got[lost] == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    tail = [(7000, t, r, x) for _, t, r, x in long[:300]]
    want = plain(tail)[0]
    assert {r[0]: r for r in run(spark, tail)}[7000] == want
    assert len(got[5000][7]) >= 11_000 and got[5000][5] > 0
    twice = [(9, 1, "user", "a."), (9, 1, "assistant", "b."), (9, 1, "user", "a."), (9, 2, "user", "c."), (9, 2, "user", "d.")]
    assert run(spark, twice) == run(spark, twice[::-1]) and run(spark, twice)[0][3] >= 1
    assert run(spark, []) == []


def test_many_at_once_as_each_alone():
    rng = np.random.default_rng(2)
    each = [((rng.integers(0, 4, n) << 2) | rng.integers(0, 4, n)).astype(np.int8) for n in rng.integers(0, 40, 300)]
    together = C.repaired(each)
    assert together == [C.repaired([c])[0] for c in each]
    assert C.repaired([np.zeros(0, np.int8)]) == [(0, b"")]
