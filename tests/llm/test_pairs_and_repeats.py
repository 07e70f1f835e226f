import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import minhash, suffixes
from millrace.llm.minhash import forest, near_duplicates, one_of_each
from millrace.llm.repeats import repeated


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked(a, b):
    both = len(a & b)
    return 100 * both >= 75 * (len(a) + len(b) - both) > 0


def least_reachable(rows):
    """Of each row: the least id that its text's links, and the ids that several texts share, reach."""
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (linked(sets[i], sets[j]) or (rows[i]["doc_id"] is not None and rows[i]["doc_id"] == rows[j]["doc_id"])):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        if r["doc_id"] is not None:
            ids[find(k)].append(r["doc_id"])
    return sets, [r["doc_id"] if not sets[k] else min(ids[find(k)], default=None) for k, r in enumerate(rows)]


def check_near(df):
    rows = df.collect()
    sets, want = least_reachable(rows)
    got = near_duplicates(df).collect()
    key = lambda d, n, c, k: (d is None, d or 0, n, c is None, c or 0, k)
    want = [(r["doc_id"], len(s), c, c is None if r["doc_id"] is None else r["doc_id"] == c) for r, s, c in zip(rows, sets, want, strict=True)]
    assert sorted((tuple(g) for g in got), key=lambda x: key(*x)) == sorted(want, key=lambda x: key(*x))


def test_near_duplicates_equal_brute_force(documents):
    check_near(documents)
    assert near_duplicates(documents.limit(0)).count() == 0


def test_near_duplicates_small_blocks(documents, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    check_near(documents)


def test_repeated_and_missing_ids(spark):
    rng = random.Random(3)
    say = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(rng.randrange(99)) for _ in range(n)]
    a, b = say(60), say(60)
    rows = [(1, a), (1, b), (2, b[:-2] + ["x", "y"]), (5, a), (5, say(50)), (None, b), (None, say(40)), (None, None), (7, []), (7, a)]
    texts = [say(40) for _ in range(12)]
    for _ in range(60):  # ids that repeat, with equal, near and other texts
        t = list(rng.choice(texts))
        if rng.random() < 0.6:
            t[rng.randrange(40)] = "changed"
        rows.append((rng.choice([None, *range(10, 40)]), t))
    df = spark.createDataFrame([(i, None if t is None else " ".join(t), "c", "s", 9, 1) for i, t in rows], "doc_id long, text string, component_id string, source string, grp int, node int")
    check_near(df)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    groups = defaultdict(list)
    plain = [{"doc_id": None, "text": r["text"], "row": k} for k, r in enumerate(df.collect())]
    sets = [shingles(r["text"]) for r in plain]
    root = list(range(len(plain)))
    for i in range(len(plain)):  # by text alone
        for j in range(len(plain)):
            if sets[i] and linked(sets[i], sets[j]):
                x, y = root[i], root[j]
                root = [x if r == y else r for r in root]
    for k, r in enumerate(df.collect()):
        groups[root[k]].append(r)
    got = kept.collect()
    assert len(got) == len(groups)
    for g in groups.values():
        same = [r for r in got if r["text"] in {x["text"] for x in g} and r["doc_id"] in {x["doc_id"] for x in g}]
        ids = [x["doc_id"] for x in g if x["doc_id"] is not None]
        assert min(ids, default=None) in [r["doc_id"] for r in same]
    assert one_of_each(df.limit(0)).count() == 0


def test_no_link_of_a_chain_is_lost(spark):
    """Neighbours at 0.754, ids shuffled; the cut at LOOSE drops only ties that others make good."""
    rows, want = [], 0
    for c in range(30):
        words = [f"w{c}x{k}" for k in range(4 + 50 + 7 * 30)]
        rows += [(c * 1000 + k, " ".join(words[7 * k : 7 * k + 54])) for k in range(30)]
        want += 1
    random.Random(4).shuffle(rows)
    ids = list(range(len(rows)))
    random.Random(5).shuffle(ids)
    got = near_duplicates(spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, rows, strict=True)], "doc_id long, text string")).filter("kept").count()
    assert got == want


def test_blocks_join_what_is_linked():
    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in range(0, 40, 2)]
    both = np.ones(len(sets), bool)
    assert len(forest(sets, both, both, 75)) == len(sets) - 1  # a chain of links of neighbours
    left = np.arange(len(sets)) % 2 == 0
    assert all(left[a] and not left[b] for a, b in forest(sets, left, ~left, 75))


@pytest.mark.parametrize("letters", [1, 2, 4, 16, 250])
def test_suffix_arrays(letters):
    rng = np.random.default_rng(letters)
    for k in range(120):
        strings = [rng.integers(0, letters, rng.integers(1, 90)) for _ in range(rng.integers(1, 5))]
        if k % 3 == 0:
            strings = [np.tile(s[:5], 20)[: len(s)] for s in strings]
        text, owner = np.concatenate(strings), np.repeat(np.arange(len(strings)), [len(s) for s in strings])
        ends = np.cumsum([len(s) for s in strings])
        want = sorted(range(len(text)), key=lambda p: (owner[p], tuple(text[p : ends[owner[p]]])))
        sa = suffixes.suffix_array(text, owner)
        assert sa.tolist() == want
        plcp = suffixes.common_prefixes(text.astype(np.uint8), text, sa, owner, ends[owner])
        for a, b in zip(sa[1:], sa[:-1], strict=True):
            n = 0
            while owner[a] == owner[b] and a + n < ends[owner[a]] and b + n < ends[owner[b]] and text[a + n] == text[b + n]:
                n += 1
            assert plcp[a] == n
    assert len(suffixes.suffix_array(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("letters", [2, 4, 16, 0])
def test_a_full_shard_goes_through_the_recursion(letters):
    """1 MiB in one shard, of random letters or (0) of words: reduced strings have tens of thousands of characters, nearly all different."""
    from millrace.llm.repeats import repeated_starts

    rng = np.random.default_rng(letters)
    if letters:
        data = rng.integers(97, 97 + letters, 1 << 20, dtype=np.uint8).tobytes()
    else:
        words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(4000)]
        data = b" ".join(words[k] for k in (rng.zipf(1.3, 300_000) % 4000).tolist())[: 1 << 20]
    copy = data[:400] + b"!" + data[-400:]
    segments = [data[i : i + 350] for i in range(0, len(data), 350)] + [copy]
    began = time.perf_counter()
    hit = repeated_starts(segments, np.zeros(len(segments), int), 200)
    assert time.perf_counter() - began < 20  # about 4 on a machine that does nothing else
    assert hit[-802:].sum() == sum(any(copy[p : p + 200] in s for s in segments[:-1]) for p in range(602))


@pytest.mark.parametrize("unit", [b"a", b"abcdefgh\n", b"ab", b"aaab"])
def test_periodic_text_takes_no_square(unit):
    from millrace.llm.repeats import repeated_starts

    data = (unit * (1 << 20))[: 1 << 20]
    began = time.perf_counter()
    hit = repeated_starts([data], np.array([0]), 200)
    assert hit[: len(data) - 199].all() and not hit[len(data) - 199 :].any()
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(("length", "shard", "long"), [(200, 1 << 20, 1 << 20), (60, 300, 500)])
def test_repeats_equal_brute_force(documents, monkeypatch, length, shard, long):
    from millrace.llm import repeats

    monkeypatch.setattr(repeats, "SHARD", shard)  # small shards go through the longer grams
    monkeypatch.setattr(repeats, "LONG", long)  # and long texts are cut
    more = documents.sparkSession.createDataFrame([(500, "abcdefgh\n" * 90, "x", "s0", 1), (501, "zz" * 400 + "abcdefgh\n" * 40, "x", "s0", 1), (-(1 << 63), "q" * 300, "x", "s0", 1), (502, "".join(chr(97 + k % 7) for k in range(130)) + "\0" * 300, "x", "s0", 1)], documents.schema)
    documents = documents.unionAll(more)
    rows = documents.union(documents.filter("doc_id = 7")).collect()
    count = defaultdict(int)
    for r in rows:
        b = (r["text"] or "").encode()
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] += 1
    grams = None if length == 200 else (20, 50, 60)
    got = repeated(documents.union(documents.filter("doc_id = 7")), length, grams).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for r in rows:
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        g = by[r["doc_id"]]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (len(b), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest())
    assert repeated(documents.limit(0)).count() == 0


def test_near_pair_amid_many_that_share_its_passage(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = say(300)
    rows = [(k, passage + " " + say(300)) for k in range(1100)] + [(5000 + k, passage + " " + say(40)) for k in range(2)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got[5001] == got[5000] == 5000 and all(got[k] == k for k in range(1100))
