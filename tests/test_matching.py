import itertools
import random
import signal
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import matching as A
from millrace.operators.stepwise import Steps, components

ORDERS = {"ordered": lambda p: (p[1], -p[3], p[2]), "first_fit": lambda p: (p[1], p[2]), "global": lambda p: (-p[3], p[1], p[2]), "global_high": lambda p: (-p[3], -p[1], -p[2])}


def one_by_one(pairs, kind):
    """The rule as it is told: all pairs of a key in order, each if both ends are free."""
    left, right, out = set(), set(), []
    for key, i, j, s in sorted(pairs, key=ORDERS[kind]):
        if (key, i) not in left and (key, j) not in right:
            left.add((key, i))
            right.add((key, j))
            out.append((key, i, j, s))
    return sorted(out)


def run(spark, pairs, kind):
    df = spark.createDataFrame(pairs, "key long, i long, j long, score double")
    return sorted(tuple(r) for r in A.match(df, "key", kind).collect())


@pytest.mark.parametrize("kind", list(ORDERS))
def test_greedy_rules_equal_one_by_one(spark, kind):
    rng = random.Random(7)
    pairs = list({(k, rng.randrange(12), rng.randrange(12)): None for k in range(40) for _ in range(rng.randrange(60))})
    pairs = [(*p, rng.randrange(4) / 4) for p in pairs]
    assert run(spark, pairs, kind) == one_by_one(pairs, kind)


@pytest.mark.parametrize("kind", list(ORDERS))
def test_one_key_of_many_pairs(spark, kind):
    """100,000 pairs of one key, with many ties, and all pairs of 300 with 300, which rule by row takes in a chain."""
    rng = np.random.default_rng(5)
    ends = np.unique(rng.integers(0, 4000, (100_000, 2)), axis=0)
    pairs = [(1, int(i), int(j), float(s)) for (i, j), s in zip(ends, rng.integers(0, 50, len(ends)) / 50, strict=True)]
    pairs += [(2, i, j, ((i * 7 + j * 13) % 97) / 97) for i in range(300) for j in range(300)]
    assert run(spark, pairs, kind) == one_by_one(pairs, kind)


@pytest.mark.parametrize("kind", A.KINDS)
def test_odd_pairs(spark, kind):
    p = spark.createDataFrame([(1, 0, 0, 0.5)], "key int, i int, j int, score double")
    assert A.match(p, "key", kind).count() == 1
    assert A.match(p.limit(0), "key", kind).count() == 0
    odd = [(1, 0, 0, 0.5), (1, 0, 0, 0.5), (None, 0, 0, 0.5), (1, None, 1, 0.5), (1, 1, None, 0.5)]
    assert run(spark, odd, kind) == [(1, 0, 0, 0.5)]


def test_a_missing_score_is_last(spark):
    pairs = [(1, 0, 0, None), (1, 0, 1, 0.1), (1, 1, 1, -2.0)]
    assert [(r[1], r[2]) for r in run(spark, pairs, "global")] == [(0, 1)]
    assert [(r[1], r[2]) for r in run(spark, pairs, "ordered")] == [(0, 1)]


def test_tie_rules(spark):
    p = [(1, 0, 0, 0.5), (1, 0, 1, 0.5), (1, 1, 0, 0.5)]
    pairs = {kind: [(i, j) for _, i, j, _ in run(spark, p, kind)] for kind in A.KINDS}
    assert pairs == {"ordered": [(0, 0)], "first_fit": [(0, 0)], "global": [(0, 0)], "global_high": [(0, 1), (1, 0)], "optimal": [(0, 1), (1, 0)]}


def test_optimal_against_all_choices(spark):
    rng = np.random.default_rng(3)
    pairs, best = [], {}
    for k in range(60):
        n, m = rng.integers(1, 6, 2)
        score = np.where(rng.random((n, m)) < 0.6, rng.integers(-2, 9, (n, m)), -np.inf)
        pairs += [(k, int(i), int(j), float(score[i, j])) for i in range(n) for j in range(m) if np.isfinite(score[i, j])]
        wide = np.full((n, m + n), 0.0)  # each row may stay alone
        wide[:, :m] = score
        best[k] = max(sum(wide[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m + n), int(n)))
    got = run(spark, pairs, "optimal")
    assert all(s >= 0 for *_, s in got) and len({(k, i) for k, i, _, _ in got}) == len({(k, j) for k, _, j, _ in got}) == len(got)
    total = dict.fromkeys(best, 0.0)
    for k, _, _, s in got:
        total[k] += s
    assert total == best


@pytest.mark.parametrize("top, unit", [(5, 1.0), (100_000, 1.0), (5, 100 / 3), (5, 1e-12), (5, 1e9)])
def test_more_left_than_right_ends(top, unit):
    """Rows that stay alone leave potentials that are no sums of scores; rounded, they went round without end."""
    signal.signal(signal.SIGALRM, lambda *_: pytest.fail("no end"))
    signal.alarm(60)
    rng = random.Random(9)
    try:
        for _ in range(200):
            n, m = rng.randrange(3, 7), rng.randrange(1, 4)
            score = {(i, j): rng.randrange(top) * unit for i in range(n) for j in range(m) if rng.random() < 0.9}
            choices = [[p for p in zip(rows, range(m), strict=True) if p in score] for rows in itertools.permutations(range(n + m), m)]
            best = max((sum(Fraction(score[p]) for p in c), len(c)) for c in choices)
            got = A._solved([(i, j, s) for (i, j), s in score.items()])
            assert len({i for i, _, _ in got}) == len({j for _, j, _ in got}) == len(got)
            assert (sum(Fraction(score[i, j]) for i, j, _ in got), len(got)) == best
    finally:
        signal.alarm(0)


def test_an_infinite_score_is_taken_first():
    inf = float("inf")
    assert sorted(A._solved([(0, 0, 9.0), (0, 1, inf), (1, 0, 2.0), (1, 1, inf), (2, 1, 1e300)])) == [(0, 0, 9.0), (1, 1, inf)]


def test_small_keys_are_solved_without_rounds_of_joins(spark, monkeypatch):
    rng = random.Random(11)
    pairs = [(k, i, j, float(rng.randrange(-1, 4))) for k in range(50) for i in range(5) for j in range(5) if rng.random() < 0.4]
    monkeypatch.setattr(A, "WHOLE", 3)
    by_joins = run(spark, pairs, "optimal")
    monkeypatch.undo()
    monkeypatch.setattr(A, "components", lambda *_: pytest.fail("rounds"))
    assert run(spark, pairs, "optimal") == by_joins


def test_label_map_error_rate_agrees_with_its_sql(spark, tmp_path):
    """Users whose values are negative, sum to zero or are missing, missing or negative ids, missing types, and five types that meet two labels."""
    from millrace.plans.catalog import ORACLE, QUERIES

    duckdb = pytest.importorskip("duckdb")
    odd = [(0, 1, "a", -1.0), (1, 1, "b", -2.0), (0, 2, "a", 0.0), (1, 2, "b", 0.0), (0, 3, "a", 5.0), (1, 3, "b", -5.0), (0, 4, "a", None), (1, 4, "b", 3.0), (0, 5, "a", None), (None, 6, "a", 1.0)]
    odd += [(None, 7, "a", 1.0), (1, 7, "b", 2.0), (-1, 8, "a", 2.0), (1, 8, "b", 1.0), (0, 9, None, 2.0), (1, 9, None, 2.0), (1, 9, "a", 3.0), (0, 9, "a", 4.0), (0, None, "a", 1.0)]
    odd += [(2 * k + b, 10 + u, t, float(1 + (u * 31 + b * 17 + k * k * 7) % 23)) for u in range(20) for k, t in enumerate("abcde") for b in (0, 1)]
    rows = spark.createDataFrame(odd, "event_id long, user_id long, event_type string, value double")
    rows.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "user_id", "event_type", "value", "'' as props").write.parquet(f"{tmp_path}/events.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["label_map_error_rate"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duckdb.sql(ORACLE["label_map_error_rate"]).fetchall()))


def test_sparse_assignment_of_a_large_component():
    """A chain of 3,000 rows in one component: the listed entries are all that is held."""
    n = 3000
    p = pd.DataFrame([(1, k, k + d, 1.0 + (k * 7 + d * 3) % 5) for k in range(n) for d in (0, 1) if k + d < n], columns=["key", "i", "j", "score"])
    got = A.best_pairs(p)
    best = [0.0, 0.0]  # the best of the rows so far, if the row's second column is free, or at all
    value = {(i, j): s for _, i, j, s in p.itertuples(index=False)}
    for k in range(n):
        stay = max(best)
        best = [max(best[0] + value[k, k], stay), max(best) + value.get((k, k + 1), -1e9)]
    assert got["i"].is_unique and got["j"].is_unique and got["score"].sum() == pytest.approx(max(best))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + k, 401 + k) for k in range(60)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(edges, "a long, b long").select(F.struct(F.col("a").alias("x")).alias("a"), F.struct(F.col("b").alias("x")).alias("b"))
    got = {r["node"]["x"]: r["component"]["x"] for r in components(df, Steps(spark, "test")).collect()}
    assert got == {x: root(x) for x in up}
