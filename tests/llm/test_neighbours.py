import numpy as np
import pytest

from millrace.llm import neighbours as N


def plain(rows, least=0.9):
    """(vec_id, n_links, component_id, kept) of each row by comparing all."""
    n, sound = len(rows), [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v in rows]
    up, links = list(range(n)), [0] * n

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(n):
        for j in range(i):
            if sound[i] and sound[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    up[root(i)] = root(j)
    ids: dict = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    least_of = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    return [(i, links[k], least_of[root(k)], i == least_of[root(k)]) for k, (i, _) in enumerate(rows)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, component_id int")
    return sorted((tuple(r) for r in N.near_vectors(df, **kw).collect()), key=str)


def planted(rng, dim, groups, spread, alone):
    rows = []
    for g in range(groups):
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        for _ in range(6):
            e = rng.normal(size=dim)
            e -= (e @ base) * base
            e /= max(np.linalg.norm(e), 1e-9)
            a = rng.uniform(0, spread)
            rows.append(((np.cos(a) * base + np.sin(a) * e) * rng.uniform(0.1, 9)).tolist())
    rows += rng.normal(size=(alone, dim)).tolist()
    return [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("dim", [64, 300])
def test_equal_to_all_pairs(spark, dim):
    rows = planted(np.random.default_rng(dim), dim, 40, 0.5, 150)
    assert run(spark, rows) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("dim", [1, 2, 5])
def test_crowded_space(spark, dim):
    """Low dimensions: buckets of very many rows, cores, and blocks against blocks."""
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(dim).normal(size=(700, dim)).tolist())]
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_large_groups(spark):
    """Exact copies, a tight group (one core), and a loose one of which only blocks are compared."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(3, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [base[0].tolist()] * 900
    rows += (base[1] + rng.normal(size=(600, 64)) * 0.01).tolist()
    rows += (base[2] + rng.normal(size=(400, 64)) * 0.045).tolist()
    rows = list(enumerate(rows))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.9).sum(axis=1) - 1
    got = {r[0]: r for r in run(spark, rows)}
    found = np.array([got[k][1] for k in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()
    assert (found[:1500] == want[:1500]).all() and {got[k][2] for k in range(900)} == {0} and {got[k][2] for k in range(900, 1500)} == {900}


def test_odd_rows(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e), (1, e), (None, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [None, 1.0, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 0.0, 0.0]), (9, [1.0, 0.0]), (2, [1e300, 1e298, 0.0]), (10, [1e-310, 0.0, 0.0]), (11, [-1.0, 0.0, 0.0]), (None, None), (12, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.1]), (13, [0.0, 0.0, -1.0]), (None, [0.0, -1.0, 0.0])]
    assert run(spark, rows) == sorted(plain(rows), key=str)
    assert run(spark, []) == []
    with pytest.raises(ValueError, match="cosine"):
        run(spark, rows, cosine=0.0)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = N.unit(rng.normal(size=(4000, 64)))
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * N.unit(e)
    bits, q, f = N.encoded(np.concatenate((x, y)))
    a = np.arange(4000)
    got, bound = N.estimates(np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1, q.astype(np.float32), f, a, a + 4000, 0.9)
    assert abs(got.mean() - 0.9) < 0.005 and (got >= bound).all() and bound.mean() > 0.5
    away, least = N.estimates(np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1, q.astype(np.float32), f, a, np.roll(a, 1), 0.9)
    assert abs(away.mean() - (x * np.roll(x, 1, axis=0)).sum(axis=1).mean()) < 0.01 and (away >= least).mean() < 0.001
