import random

import pytest

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu") for b in ("n", "r", "st", "lt", "ck")]


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with every oddity: nulls, blanks, copies, near copies, shared passages, a very long text, a clashing column."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, passage = say(120), say(70)
    rows = [(k, say(rng.randint(1, 90)), "x", f"s{k % 3}") for k in range(40)]
    rows += [(100 + k, base, "x", "s0") for k in range(5)]
    for k in range(30):
        words = base.split()
        for _ in range(k % 6):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((200 + k, " ".join(words), "x", "s0"))
    rows += [(300 + k, say(30) + " " + passage + " " + say(30), "y", None) for k in range(6)]
    rows += [(400, None, None, None), (401, "", "x", "s1"), (402, " \t\n", "x", "s1"), (403, "é" * 150 + " ÀÉ ßx", "y", "s2"), (404, "a" * 900, "y", "s2"), (405, say(20_000), "x", "s2"), (406, "one two", "x", "s1"), (407, "One\tTWO", "x", "s1"), (None, say(40), "x", "s0")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, copies int")
