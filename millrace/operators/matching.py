"""One-to-one matching within a key, of pairs (key, i, j, score) that a condition of the caller's has found.

Greedy rules take pairs in a total order, each if both its ends are free. A pair that comes first among those of its left
end and among those of its right end is taken whatever else there is; so rounds take all such pairs of all keys at once and
drop what they block, with partial minima and joins: no key is gathered. Rules that go row by row can leave chains, in
which a round takes little. As soon as a round drops less than half of the pairs, what is left passes in order, and only the ends
that are taken are remembered.

An optimal assignment falls apart into connected components of the pairs; each is solved on its own, over the listed pairs.
Keys of up to WHOLE pairs are split into components where they are solved, larger ones by joins.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.stepwise import Steps, components

WHOLE = 4096  # so many pairs of a key a task holds at once


def _order(kind: str) -> Column:
    """A key of the order in which pairs are tried; a missing score comes last, and the pair itself stands behind all."""
    i, j, high = F.col("i"), F.col("j"), -F.coalesce(F.col("score"), F.lit(float("nan")))
    keys = {"ordered": (i, high, j), "first_fit": (i, j, high), "global": (high, i, j), "global_high": (high, -i, -j)}[kind]
    return F.struct(*(k.alias(f"o{n}") for n, k in enumerate(keys)), i.alias("i"), j.alias("j"), F.col("score").alias("score"))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs arrive by key and order: those whose ends are free go out."""
    now, left, right = None, set(), set()
    for batch in batches:
        take = []
        for n, (key, i, j) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
            if key != now:
                now, left, right = key, set(), set()
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                take.append(n)
        yield batch.take(pa.array(take, pa.int64()))


def greedy(pairs: DataFrame, kind: str) -> DataFrame:
    """The pairs that are taken in order `ordered` (left rows in turn, each its best partner), `first_fit` (each its first), `global` or `global_high` (falling score, ties by low or by high i and j). Pairs without a key or an end take no part; of equal pairs one."""
    steps = Steps(pairs.sparkSession, "matching")
    now = steps.put(pairs.dropna(subset=["key", "i", "j"]).select("key", "i", "j", _order(kind).alias("o")), "pairs-0")
    many, k, out = now.count(), 0, None
    while many:
        first = now.groupBy("key", "i").agg(F.min("o").alias("o")).join(now.groupBy("key", "j").agg(F.min("o").alias("o")), ["key", "o"])
        taken = steps.put(first.select("key", "o.i", "o.j", "o.score"), f"taken-{k}")
        out = taken if out is None else out.unionAll(taken)
        rest = now.join(taken.select("key", "i"), ["key", "i"], "left_anti").join(taken.select("key", "j"), ["key", "j"], "left_anti")
        k += 1
        now = steps.put(rest.select("key", "i", "j", "o"), f"pairs-{k}")
        steps.drop(f"pairs-{k - 1}")
        had, many = many, now.count()
        if 2 * many > had:
            line = now.repartition("key").sortWithinPartitions("key", "o").select("key", "i", "j", "o.score")
            return out.unionAll(line.mapInArrow(_in_order, line.schema))
    return out if out is not None else now.select("key", "i", "j", "o.score")


def assigned(costs: list[list[tuple[int, int]]], columns: int) -> list[int]:
    """A column for each row, of least total cost; costs lists each row's columns, of which every set of rows must have enough. Shortest augmenting paths over the listed entries, with potentials; whole numbers, as rounded potentials make rings of columns that get nearer at each turn, without end."""
    u, v, row_of, column_of = [0] * len(costs), [0] * columns, [-1] * columns, [-1] * len(costs)
    for start, own in enumerate(costs):
        u[start] = min(c - v[j] for j, c in own)
        far: dict[int, int] = {}
        came: dict[int, int] = {}
        done: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        row, base = start, 0
        while True:
            for j, c in costs[row]:
                d = base + c - u[row] - v[j]
                if j not in done and (j not in far or d < far[j]):
                    far[j], came[j] = d, row
                    heapq.heappush(heap, (d, j))
            while True:
                d, at = heapq.heappop(heap)
                if at not in done:
                    break
            if row_of[at] < 0:
                break
            done[at] = d
            row, base = row_of[at], d
        u[start] += d
        for j, near in done.items():
            u[row_of[j]] += d - near
            v[j] -= d - near
        while at >= 0:
            row = came[at]
            row_of[at], column_of[row], at = row, at, column_of[row]
    return column_of


Pair = tuple[int, int, float]


def _whole(scores: list[float]) -> list[int]:
    """Scores from 0 on as whole numbers of one unit, exactly; an infinite one is more than all others together."""
    parts = [s.as_integer_ratio() if s < math.inf else None for s in scores]
    unit = max((p[1] for p in parts if p), default=1)  # powers of two
    parts = [p and p[0] * (unit // p[1]) for p in parts]
    over = sum(p for p in parts if p is not None) + 1
    return [over if p is None else p for p in parts]


def _solved(pairs: list[Pair]) -> list[Pair]:
    """The pairs of greatest total score, one for each end at most; a pair of score 0 is taken rather than none, one below never."""
    best: dict[tuple[int, int], float] = {}
    for i, j, s in pairs:
        if s >= 0 and s > best.get((i, j), -1.0):
            best[i, j] = s
    lefts = {i: k for k, i in enumerate(sorted({i for i, _ in best}))}
    rights = sorted({j for _, j in best})
    place = {j: k for k, j in enumerate(rights)}
    costs: list[list[tuple[int, int]]] = [[(len(rights) + k, 1)] for k in range(len(lefts))]  # its own place to stay alone
    ends = sorted(best)
    for (i, j), s in zip(ends, _whole([best[p] for p in ends]), strict=True):
        costs[lefts[i]].append((place[j], -s * (len(lefts) + 1)))  # all that stay alone cost less than a unit of score
    columns = assigned(costs, len(rights) + len(lefts))
    return [(i, rights[b], best[i, rights[b]]) for i, b in zip(lefts, columns, strict=True) if b < len(rights)]


def _parts(pairs: list[Pair]) -> Iterable[list[Pair]]:
    """Connected components of pairs."""
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def root(x: tuple[int, int]) -> tuple[int, int]:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for i, j, _ in pairs:
        up[root((0, i))] = root((1, j))
    out: dict[tuple[int, int], list[Pair]] = {}
    for p in pairs:
        out.setdefault(root((0, p[0])), []).append(p)
    return out.values()


def _settled(pairs: list[Pair]) -> Iterator[Pair]:
    """Of a key's pairs those that are taken. Where all pairs of a component share an end the best one is the answer."""
    for part in _parts(pairs):
        if len({i for i, _, _ in part}) == 1 or len({j for _, j, _ in part}) == 1:
            i, j, s = max(part, key=lambda p: (p[2], -p[0], -p[1]))
            if s >= 0:
                yield i, j, s
        else:
            yield from _solved(part)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (key, component, i, j, score) arrive by key and component: what is taken of each."""
    now, held, out, kind = None, [], [], None

    def shown() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 4, kind, strict=True)], schema=kind)

    for batch in batches:
        kind = pa.schema([batch.schema.field(n) for n in (0, 2, 3, 4)])
        for key, part, *pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, part) != now:
                out += [(now[0], *p) for p in _settled(held)] if now else []
                now, held = (key, part), []
            held.append(tuple(pair))
        if len(out) > 10_000:
            yield shown()
            out = []
    if now:
        out += [(now[0], *p) for p in _settled(held)]
        yield shown()


def best_pairs(pairs: pd.DataFrame) -> pd.DataFrame:
    """The same of a frame."""
    return pd.DataFrame(_solved(list(pairs[["i", "j", "score"]].itertuples(index=False, name=None))), columns=["i", "j", "score"])


def _components(own: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Of large keys: what is taken of components whose pairs share an end, and the pairs of the other components."""
    end = lambda side, c: F.struct(F.col("key"), F.lit(side).alias("side"), F.col(c).alias("id"))
    label = components(own.select(end(0, "i").alias("a"), end(1, "j").alias("b")), steps)
    parts = steps.put(own.withColumn("node", end(0, "i")).join(label, "node").select("key", F.xxhash64("component").alias("component"), "i", "j", "score"), "parts")
    one = (F.min("i") == F.max("i")) | (F.min("j") == F.max("j"))
    best = F.max_by(F.struct("i", "j", "score"), F.struct(F.col("score"), -F.col("i"), -F.col("j")))
    stars = parts.groupBy("key", "component").agg(one.alias("one"), best.alias("p"))
    return stars.filter("one").select("key", "p.*").filter("score >= 0"), parts.join(stars.filter("not one"), ["key", "component"], "left_semi")


def optimal(pairs: DataFrame) -> DataFrame:
    """The pairs of greatest total score in each key: what a task holds is a key of at most WHOLE pairs, or a connected component of a larger one."""
    steps = Steps(pairs.sparkSession, "assignment")
    own = steps.put(pairs.dropna(), "pairs")
    large = own.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > WHOLE).select("key")
    rows, taken = own.select("key", F.lit(0).cast("long").alias("component"), "i", "j", "score"), None
    if not large.isEmpty():
        taken, rest = _components(steps.put(own.join(large, "key", "left_semi"), "large"), steps)
        rows = rows.join(large, "key", "left_anti").unionAll(rest.select(*rows.columns))
    out = rows.repartition("key", "component").sortWithinPartitions("key", "component").mapInArrow(_by_key, own.schema)
    return out if taken is None else out.unionAll(taken)


KINDS = ("ordered", "first_fit", "global", "global_high", "optimal")


def match(pairs: DataFrame, key: str, kind: str) -> DataFrame:
    """Of pairs (key, i, j, score) those that the matching takes."""
    pairs = pairs.selectExpr(f"`{key}` as key", "cast(i as long) as i", "cast(j as long) as j", "cast(score as double) as score")
    return optimal(pairs) if kind == "optimal" else greedy(pairs, kind)
