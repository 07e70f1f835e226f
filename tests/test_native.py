"""Operators in JVM expressions against plain Python."""

import json
import random
import shlex

import pytest
from pyspark.sql import functions as F

from millrace.functions import nested as N
from millrace.functions import text as X
from millrace.operators import metrics as M
from millrace.operators import quality as Q
from millrace.operators import reward as W


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.select("k", make(F.col("v")).alias("out")).orderBy("k").select("out").collect()]


def test_shell_words_equal_the_shells(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab/. '\"\\\t\né") for _ in range(rng.randrange(24))) for _ in range(3000)]
    texts += ["cat '/etc/a b' \"/x\\\"y\" z\\ w", "", " ", "a" * 20_000, "'" + "b \\" * 5000 + "'", '"' + '\\" ' * 3000 + '"', "x'y'\"z\"\\w", "''", '"" a']

    def plain(t):
        try:
            return shlex.split(t)
        except ValueError:
            return t.split()

    assert column(spark, texts, W.shell_words) == [plain(t) for t in texts]


def test_escapes(spark):
    rng = random.Random(2)
    parts = ["/tmp", "/workspace", "/work/job", "/work", "..", ".", "/", "//", "a", "/etc", "'", '"', " ", " ", " ", "\\", "/tmpx", "answer_KEY"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(2000)] + [None, "python -c 'n / len(x)'", "cat '/data/a b'", "ls /tmp/../etc", "x.GOLD"]

    def plain(t):
        if t is None:
            return None
        low = t.lower()
        if any(g in low for g in ("ground_truth", "answer_key", "gold_answer", ".gold")):
            return True
        try:
            words = shlex.split(t)
        except ValueError:
            words = t.split()
        for w in words:
            if w.startswith("/") and w != "/":
                at = []
                for p in w.split("/"):
                    if p == "..":
                        at = at[:-1]
                    elif p not in ("", "."):
                        at.append(p)
                if not (at[:1] in (["tmp"], ["workspace"]) or at[:2] == ["work", "job"]):
                    return True
        return False

    assert column(spark, texts, lambda c: W.escapes(c, "/work/./job".replace("./", ""))) == [plain(t) for t in texts]


def test_word_distance_equals_the_table_of_distances(spark):
    rng = random.Random(3)
    pairs = [(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(12))), "  ".join(rng.choice("abcdh") for _ in range(rng.randrange(12)))) for _ in range(400)]
    many = [f"w{k}" for k in range(60_000)]  # beyond the numbers of half pairs
    pairs += [("", ""), ("a", ""), ("", "a"), (None, "a"), ("a", None), (" ".join(many[:300] + many[-300:]), " ".join(many[100:300] + many[-300:]))]

    def plain(a, b):
        if a is None or b is None:
            return None
        a, b = a.split(), b.split()
        if not a:
            return float(bool(b))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1] / len(a)

    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = df.select("k", X.word_error_rate(F.col("a"), F.col("b")).alias("w")).orderBy("k")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    want = [plain(a, b) for a, b in pairs]
    assert [r["w"] if r["w"] is None else pytest.approx(r["w"]) for r in got.collect()][:-3] == want[:-3]
    assert [r["w"] for r in got.collect()] == pytest.approx([plain(a or "", b or "") if w is None else w for (a, b), w in zip(pairs, want, strict=True)])
    codes = spark.range(1, 1_000_000, 9973).select(F.count_distinct(X._symbol(F.col("id"))).alias("n"), F.max(F.length(X._symbol(F.col("id")))).alias("l"), F.count("*").alias("all")).first()
    assert codes["n"] == codes["all"] and codes["l"] == 1


def tau_b(rows):
    """By all pairs."""
    s = ua = ub = 0
    for i, (a, b) in enumerate(rows):
        for c, d in rows[:i]:
            x, y = (a > c) - (a < c), (b > d) - (b < d)
            s, ua, ub = s + x * y, ua + abs(x), ub + abs(y)
    return s / (ua * ub) ** 0.5 if ua and ub else None


def test_tau_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(5) if k % 2 else rng.random(), rng.randrange(4)) for k in range(30) for _ in range(rng.randrange(1, 25))]
    rows += [(100, None, 1), (100, 1.0, 2), (101, 1.0, 1), (101, 1.0, 2)]
    got = {r["k"]: r["tau"] for r in M.kendall_tau(spark.createDataFrame([(k, None if a is None else float(a), b) for k, a, b in rows], "k long, a double, b long"), ["k"], "a", "b").collect()}
    want = {k: tau_b([(a, b) for x, a, b in rows if x == k]) for k in {r[0] for r in rows} if sum(r[0] == k and r[1] is not None for r in rows) > 1}
    assert set(got) == set(want)
    assert all(got[k] == (None if want[k] is None else pytest.approx(want[k])) for k in want)


def test_tau_of_one_large_key(spark):
    """100,000 rows of one key against a count by a tree of sums."""
    rng = random.Random(5)
    n = 100_000
    rows = [(a, a // 3 + rng.randrange(n // 4)) for a in (rng.randrange(n // 2) for _ in range(n))]
    rank = {b: k + 1 for k, b in enumerate(sorted({b for _, b in rows}))}
    tree, opposite, at = [0] * (len(rank) + 1), 0, 0
    rows.sort()
    while at < n:
        end = at
        while end < n and rows[end][0] == rows[at][0]:
            end += 1
        for _, b in rows[at:end]:
            k, below = rank[b], 0
            while k:
                below, k = below + tree[k], k & (k - 1)
            opposite += at - below
        for _, b in rows[at:end]:
            k = rank[b]
            while k < len(tree):
                tree[k] += 1
                k += k & -k
        at = end
    ties = lambda values: sum(c * (c - 1) // 2 for c in __import__("collections").Counter(values).values())
    pairs, ta, tb, tab = n * (n - 1) // 2, ties(a for a, _ in rows), ties(b for _, b in rows), ties(rows)
    want = (pairs - ta - tb + tab - 2 * opposite) / ((pairs - ta) * (pairs - tb)) ** 0.5
    got = M.kendall_tau(spark.createDataFrame([(1, a, b) for a, b in rows], "k int, a long, b long"), ["k"], "a", "b").first()
    assert got["tau"] == pytest.approx(want, rel=1e-12)


def nested(rng, level):
    kind = rng.randrange(6) if level else rng.randrange(2, 6)
    if kind == 0:
        return {f"k{k}": nested(rng, level - 1) for k in range(rng.randrange(4))}
    if kind == 1:
        return [nested(rng, level - 1) for _ in range(rng.randrange(4))]
    return rng.choice(['a "b": {', "x\\", "é\n", "", "[:]", " "]) if kind < 4 else rng.choice([1, None, True, 2.5])


def walk(v, path="root", names=()):
    if isinstance(v, dict) and v:
        return [x for k, w in v.items() for x in walk(w, f"{path}.{k}", (*names, k))]
    if isinstance(v, list) and v:
        return [x for k, w in enumerate(v) for x in walk(w, f"{path}[{k}]", names)]
    return [(path, names, v)]


def test_leaves_and_paths_of_nested_values(spark):
    rng = random.Random(6)
    values = [nested(rng, 5) for _ in range(300)]
    texts = [json.dumps(v, ensure_ascii=k % 2 == 0) for k, v in enumerate(values)] + ["no json", "", "{", None]
    strings = [[x for _, _, x in walk(v) if isinstance(x, str)] for v in values]
    assert column(spark, texts, N.leaves) == [*strings, [], [], [], None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, j string")
    got = {(r["k"], r["path"], tuple(r["names"]), r["value"]) for r in N.flattened(df, "j").collect()}
    say = lambda x: None if x is None or x in ({}, []) else x if isinstance(x, str) else json.dumps(x)
    assert got == {(k, p, n, say(x)) for k, v in enumerate(values) for p, n, x in walk(v)}


def test_secrets_at_any_level(spark):
    rows = [(1, '{"a": [{"Api-Key": {"x": [1]}}, "fine"]}'), (2, '{"a": {"b": {"c": ["see /home/me/x"]}}}'), (3, '{"a": "ok"}'), (4, '["password = hunter2"]'), (5, '{"cookie": {}}'), (6, None)]
    got = Q.nested_secrets(spark.createDataFrame(rows, "id int, j string"), "j").collect()
    assert sorted(map(tuple, got)) == [(1, "root.a[0].Api-Key.x[0]", "name"), (2, "root.a.b.c[0]", "value"), (4, "root[0]", "value"), (5, "root.cookie", "name")]


def test_tau_has_tasks_of_bounded_size(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") % 97).alias("k"), F.col("id").alias("a"), (F.col("id") * 7 % 31).alias("b"))
    want = sorted(map(tuple, M.kendall_tau(df, ["k"], "a", "b").collect()))
    monkeypatch.setattr(M, "TASK_ROWS", 100)
    got = M.kendall_tau(df, ["k"], "a", "b")
    assert "20), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want
