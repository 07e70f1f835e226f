import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprints as P
from millrace.llm import licenses, mixing, packing, topk, urlfilter
from millrace.llm.queries import tokenizer_path


def test_mixing(documents):
    got = mixing.mixed(documents).collect()
    assert len(got) == documents.count()
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert sum(t for _, t in by) == pytest.approx(sum(s for s, _ in by))
    assert all(t <= 3 * s + 1e-6 for s, t in by)
    again = mixing.mixed(documents.repartition(7)).collect()
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in got) == sorted((r["doc_id"] or -1, r["taken"]) for r in again)
    assert mixing.mixed(documents.limit(0)).count() == 0
    assert mixing.mixed(documents.filter("text is null")).first()["taken"] == 0


def test_targets_are_shared_again_until_none_is_above(spark):
    rng = np.random.default_rng(4)
    for _ in range(5):
        sizes = rng.integers(0, 1000, 9).tolist()
        df = spark.createDataFrame([(f"s{k}", f"{k}", s) for k, s in enumerate(sizes)], "skey string, source string, source_size long")
        got = {r["skey"]: r["target"] for r in mixing.targets(df).collect()}
        weight, want, full = [(5, 2, 1)[k % 3] for k in range(9)], [0.0] * 9, set()
        while True:  # round by round, as the rule is told
            rest = sum(sizes) - sum(3 * sizes[k] for k in full)
            share = sum(weight[k] for k in range(9) if k not in full)
            want = [3.0 * sizes[k] if k in full else rest * weight[k] / share for k in range(9)]
            above = {k for k in range(9) if k not in full and want[k] > 3 * sizes[k]}
            if not above:
                break
            full |= above
        assert [got[f"s{k}"] for k in range(9)] == pytest.approx(want)


def test_sketches(spark, documents):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 900)]
    a, b = " ".join(words[:700]), " ".join(words[200:])
    s = spark.createDataFrame([(a, b)], "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    r = s.select(P.resemblance(F.col("a"), F.col("b")).alias("j"), P.containment(F.col("a"), F.col("b")).alias("c"), P.distinct_count(F.col("a")).alias("n"), P.merge(F.col("a"), F.col("b")).alias("m")).first()
    assert r["j"] == pytest.approx(496 / 896, abs=0.15) and r["c"] == pytest.approx(496 / 696, abs=0.2) and r["n"] == pytest.approx(696, rel=0.3)
    sh = lambda ws: {hashlib.md5(" ".join(ws[i : i + 5]).encode()).hexdigest()[:16] for i in range(len(ws) - 4)}
    assert r["m"] == sorted(sh(words[:700]) | sh(words[200:]))[:128]
    got = {x["doc_id"]: x for x in P.fingerprints(documents).collect()}
    rows = sorted(documents.collect(), key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0))
    for x, nxt in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = x["text"] or "", nxt["text"] or ""
        half = len(t) // 2
        g = got[x["doc_id"]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest())
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
    assert got[100]["fingerprint"] == got[101]["fingerprint"] and got[100]["near_next"] == 1.0
    assert P.fingerprints(documents.limit(0)).count() == 0
    assert P.fingerprints(documents.filter("doc_id = 5")).first()["near_next"] == 1.0


def test_packing_round_trip(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = {}
    rows = packing.packed(documents, tokenizer_path()).collect()
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for d in documents.collect():
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        at = 0
        for r in sorted(got[d["doc_id"]], key=lambda r: r["start"]):
            assert (r["start"], r["offset"], r["doc_tokens"]) == (at, 0, len(ids) // 4)
            assert r["length"] <= 1024 and r["length"] & (r["length"] - 1) == 0
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    assert packing.packed(documents.limit(0), tokenizer_path()).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.packed(documents, tokenizer_path(), 1000)


LONG = [" " * 1_000_000, "\n" * 1_000_000, "x" + " " * 5000 + "y", "x" + " \n" * 4000 + "\n!", "\u3000" * 5000 + "a", "a" * 300_000, "ab " * 100_000 + " " * 9000, "x\x1c" * 5000, ("é" + " " * 4096) * 3]


@pytest.mark.parametrize("text", [*LONG, "a<|endoftext|>", "<|endoftext|><|endoftext|> <|endof", "a  <|endoftext|>  b " + " " * 5000 + "<|endoftext|>", "", " ", "  ", "a ", " a", "a  b", "a \n b", "a\n b", "it's  x ", "<|endoftext|> hi", "é\x1c b  c", "x  y"])
def test_encoder_equals_the_tokenizer(text):  # with its defaults
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    assert np.frombuffer(packing.encoder(tokenizer_path())(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    x[50:90] = x[50]  # ties
    rows = [(k, [float(v) for v in x[k]]) for k in range(300)] + [(400, None), (420, [1.0, float("nan")] * 4), (440, [float("inf")] * 8), (460, [None] * 8), (480, [1.0] * 3), (500, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = np.floor(64 * x).astype(int)
    got = {}
    for r in topk.top_inner(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 20)) | {480, 500}
    for q in range(0, 300, 20):
        order = sorted((-int(whole[q] @ whole[k]), k) for k in range(300) if k != q)[:20]
        assert sorted(got[q]) == [(i + 1, k, -s) for i, (s, k) in enumerate(order)]
    assert sorted(got[480]) == [(1, 500, 64 * 64 * 3)]
    assert topk.top_inner(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("dim", [1, 2, 8, 64])
@pytest.mark.parametrize("far", [1e3, 1e5, 1e7])
def test_top_k_with_an_outlier(spark, monkeypatch, dim, far):
    """A vector far from all others is always a pivot; distances to it have few digits left for the others."""
    monkeypatch.setattr(topk, "DATA_BLOCK", 128)
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(500, dim))
    x[7] = far * rng.normal(size=dim)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    whole = np.floor(64 * x).astype(np.int64)
    got = topk.top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, k=6).collect()
    scores = whole @ whole.T
    want = {(q, rank + 1, int(j), int(scores[q, j])) for q in range(0, 500, 5) for rank, j in enumerate([j for j in np.lexsort((np.arange(500), -scores[q])) if j != q][:6])}
    assert {tuple(r) for r in got} == want


def test_rows_that_repeat_an_id_are_queries_of_their_own(spark):
    rows = [(20, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (20, [0.0, 1.0], 1), (3, [0.5, 0.25], 1)]
    got = topk.top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), F.col("vec_id") % 20 == 0).collect()
    want = []
    for i, (a, x, _) in enumerate(rows[:3]):
        order = sorted((-sum(int(64 * p) * int(64 * q) for p, q in zip(x, y, strict=True)), b) for j, (b, y, _) in enumerate(rows) if j != i)
        want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(order)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_bounds_decide_what_is_evaluated():
    """On vectors in clusters most products are never computed, and the result is that of all products."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(24, 16)) * 400
    x = np.rint(centres[rng.integers(0, 24, 6000)] + rng.normal(size=(6000, 16)) * 10).astype(np.int64)
    rows, ids = np.arange(6000), rng.permutation(6000)
    sample = topk.Sample(rows[::3].tolist(), list(x[::3]), 32)
    ask = np.arange(0, 6000, 100)
    best = topk.Best(ids[ask], rows[ask], x[ask], sample.table(x[ask]), sample.least(rows[ask], x[ask], 20), 20)
    order = np.argsort(sample.table(x).argmin(axis=1), kind="stable")
    for at in range(0, 6000, 500):
        part = order[at : at + 500]
        best.offer(ids[part], rows[part], x[part], sample.table(x[part]))
    for j, q in enumerate(ask):
        scores = x @ x[q]
        want = sorted((-int(scores[r]), int(ids[r])) for r in rows if r != q)[:20]
        assert [(-int(s), int(n)) for s, n in zip(*best.found[j], strict=True)] == want
    assert best.evaluated < 0.2 * len(ask) * 6000


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit-permission"]
    changed = mit.replace("free of charge", "at no charge at all").replace("sublicense, ", "")
    rows = [(1, "x " * 500 + mit + " y" * 400), (2, "code\n" + changed), (3, "Released under the\nMIT license"), (4, "Released under some terms"), (5, None), (6, ""), (None, licenses.TEMPLATES["gpl-3.0-line"] + " and again " + licenses.TEMPLATES["gpl-3.0-line"])]
    got = {}
    for r in licenses.license_matches(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, words int")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [r["license_id"] for r in got[1]] == ["mit-permission"] and got[1][0]["coverage"] == 1.0
    text = rows[0][1].encode()
    assert text[got[1][0]["byte_start"] : got[1][0]["byte_end"]].decode() == mit.rstrip(".")
    assert [r["license_id"] for r in got[2]] == ["mit-permission"] and 0.9 < got[2][0]["coverage"] < 1
    assert [r["license_id"] for r in got[3]] == ["mit-line"]
    assert len(got[None]) == 2 and not {4, 5, 6} & set(got)
    assert licenses.license_matches(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 6, 40])
def test_notices_in_a_row_are_all_found(spark, n):
    lines = {"mit-line": "Released under the MIT License. ", "bsd-line": "Released under the BSD License. ", "apache-2.0-line": "Licensed under the Apache License, Version 2.0. ", "cc-by-4.0-short": "Licensed under CC BY 4.0. "}
    rows = [(k, x * n, 1) for k, x in enumerate(lines.values())] + [(9, "".join(lines.values()) * n, 1)] + [(k, "Released under the\n" + x * n, 1) for k, x in enumerate(lines.values(), 20)]
    got = {}
    for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string, license_id int")).collect():
        got.setdefault(r["doc_id"], []).append((r["word_start"], r["word_end"], r["license_id"]))
    for k, name in enumerate(lines):
        for d in (k, 20 + k):
            found = sorted(got[d])
            assert [x[2] for x in found] == [name] * n and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    assert sorted(x[2] for x in got[9]) == sorted([*lines] * n)


def test_scan_equals_alignment_at_every_place():
    """Against brute force: no exact copy of a template at any place is without its candidate."""
    rng = np.random.default_rng(11)
    templates = {"a": "one two three four five six", "b": "two three four nine ten", "c": "six seven eight nine"}
    index, words = licenses.Index(templates, 3, 2), [*"one two three four five six seven eight nine ten".split(), "x"]
    hashes = {w: licenses.K.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in words}
    for _ in range(60):
        text = [words[k] for k in rng.integers(0, len(words), 8)]
        for _ in range(3):
            at = rng.integers(0, len(text) + 1)
            text[at:at] = templates["abc"[rng.integers(0, 3)]].split()
        h = np.array([hashes[w] for w in text], np.uint64)
        prints, places = licenses.winnow(h, 3, 2)
        found = {(t, p[0], p[-1]) for t, s in index.candidates(prints, places, 12) if (p := [y for _, y in licenses.align(index.words[t], h, s, index.band(t, 12))]) and len(p) == len(index.words[t])}
        for t, w in enumerate(index.words):  # every exact copy is within a whole alignment of its own
            for at in range(len(h) - len(w) + 1):
                if (h[at : at + len(w)] == w).all():
                    assert any(t == u and at - index.band(t, 12) <= a <= at and b >= at + len(w) - 1 for u, a, b in found)


@pytest.mark.parametrize("text", ["x " * 300_000 + licenses.TEMPLATES["mit-permission"], licenses.TEMPLATES["mit-line"] + " z" * 300_000])
def test_license_in_a_very_long_text(spark, text):
    got = licenses.license_matches(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0]["coverage"] == 1.0


def test_common_licenses(spark):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-short", "Licensed under CC BY 4.0": "cc-by-4.0-short", "licensed under cc by-sa 3.0": "cc-by-sa-3.0-short", "Licensed under CC BY-NC-ND 2.0": "cc-by-nc-nd-2.0-short"}
    lines |= {"This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-4.0-line"}
    lines |= {"This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0-line", "This work is licensed under the GNU Lesser General Public License, version 2.1.": "lgpl-2.1-line", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0-line"}
    rows = [(k, "some words before " + x + " and after it") for k, x in enumerate(lines)]
    got = {}
    for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r["license_id"])
    assert [got.get(k) for k in range(len(lines))] == [[x] for x in lines.values()]


def test_whole_license_texts_with_changed_words(spark):
    """Each text under another name and year, with one word of twenty replaced, some left out and some put in."""
    rng = np.random.default_rng(4)
    rows = []
    for k, (name, text) in enumerate(sorted(licenses.TEXTS.items())):
        words = text.split()
        for at in rng.choice(len(words), len(words) // 20, replace=False):
            words[at] = f"changed{at}"
        del words[10], words[40]
        words[30:30] = ["put", "in"]
        rows.append((k, f"Copyright (c) 20{k} Some Body\n\n" + " ".join(words) + "\nand what comes after it", name))
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = {r["doc_id"]: r for r in licenses.license_matches(df).collect()}
    assert {k: r["license_id"] for k, r in got.items()} == {k: name for k, _, name in rows}
    for k, text, _ in rows:
        raw = text.encode()
        assert got[k]["coverage"] > 0.9 and raw[: got[k]["byte_start"]].decode().count("\n") == 2 and b"after" not in raw[: got[k]["byte_end"]]


def test_long_licenses(spark):
    """Whole, with one word of twenty replaced and a paragraph put in, twice in one text; half a text is no match."""
    rng, texts = np.random.default_rng(5), licenses.long_texts()
    rows, whole = [], {}
    for k, (name, text) in enumerate(sorted(texts.items())):
        words = text.split()
        whole[k] = len(words)
        for at in rng.choice(len(words), len(words) // 20, replace=False):
            words[at] = f"changed{at}"
        words[len(words) // 3 : len(words) // 3] = ["put", "in"] * 5
        rows += [(k, "before it " + " ".join(words)), (k + 10, text), (k + 20, " ".join(text.split()[: len(text.split()) // 2]))]
    rows.append((30, texts["apache-2.0-text"] + " and between them " + texts["apache-2.0-text"]))
    got: dict = {}
    for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for k, name in enumerate(sorted(texts)):
        (changed,), (same,) = got[k], got[k + 10]
        assert changed["license_id"] == same["license_id"] == name and same["coverage"] == 1 and 0.9 < changed["coverage"] < 1
        assert abs(changed["word_end"] - changed["word_start"] - same["words"]) < 0.02 * whole[k] + 40
        assert not any(r["license_id"] == name for r in got.get(k + 20, []))
    assert [r["license_id"] for r in got[30]] == ["apache-2.0-text"] * 2 and all(r["coverage"] == 1 for r in got[30])


def test_every_license_line_of_the_given_documents_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text rlike '(?i)(licensed|released) under'")
    found = licenses.license_matches(docs).groupBy("doc_id").agg(F.count("*").alias("n"))
    lines = F.size(F.regexp_extract_all("text", F.lit("(?i)(licensed|released) under"), 0))
    assert docs.count() and docs.join(found, "doc_id", "left").filter(F.coalesce("n", F.lit(0)) < lines).count() == 0


def test_alignment_finds_the_longest_common_subsequence():
    rng = np.random.default_rng(9)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64)
        m = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                m[i + 1, j + 1] = max(m[i, j + 1], m[i + 1, j], m[i, j] + (a[i] == b[j]))
        pairs = licenses.align(a, b, 0, 12)
        assert len(pairs) == m[-1, -1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_lists_as_of(spark):
    e = spark.createDataFrame([("l", "host", "a.b.com", "block", "2024-01-10"), ("l", "host", "a.b.com", "remove", "2024-02-01"), ("l", "domain", "b.com", "allow", "2024-01-05"), ("l", "prefix", "a.b.com/x", "allow", "2024-01-12"), ("l", "host", None, "block", "2024-01-01")], "list_id string, scope string, value string, action string, listed_at string").withColumn("listed_at", F.col("listed_at").cast("date"))
    c = spark.createDataFrame([(1, "http://a.b.com/y", "2024-01-01"), (2, "http://a.b.com/y", "2024-01-07"), (3, "https://u@A.b.com.:443/y", "2024-01-10"), (4, "http://a.b.com/x/z?q", "2024-01-15"), (5, "http://a.b.com/", "2024-02-01"), (6, None, "2024-01-15"), (7, "http://c.b.com", None), (8, "nonsense", "2024-01-15")], "page_id long, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("date")).withColumn("scope", F.lit(1))
    got = {r["page_id"]: (r["decision"], r["active"]) for r in urlfilter.as_of(c, e).collect()}
    assert got == {1: ("none", 0), 2: ("allow", 1), 3: ("block", 2), 4: ("allow", 3), 5: ("allow", 1), 6: ("none", 0), 7: ("none", 0), 8: ("none", 0)}
    assert urlfilter.as_of(c.limit(0), e).count() == 0 and urlfilter.as_of(c, e.limit(0)).count() == 8


def test_lists_on_repeated_captures_and_odd_hosts(spark):
    e = spark.createDataFrame([("l", "host", "a.com", "block", "2024-01-10"), ("m", "host", "a.com", "allow", "2024-01-10"), ("l", "domain", "com", "allow", "2024-01-01"), ("l", "host", "a.com", "allow", "2024-01-20"), ("l", "host", "a.com", "block", "2024-01-20")], "list_id string, scope string, value string, action string, listed_at string").withColumn("listed_at", F.col("listed_at").cast("date"))
    urls = ["http://a.com/", "http://a.com/", "http://a..com/x", "http://.com", "http://", "http://a.com" + "/d" * 300, "", None]
    rows = [(7 if k < 2 else k, u, "2024-01-15", "x", 3) for k, u in enumerate(urls)] + [(None, "http://a.com/", "2024-01-15", "x", 3), (8, "http://a.com/", "2024-01-20", "x", 3)]
    c = spark.createDataFrame(rows, "page_id long, url string, fetched_at string, decision string, active int").withColumn("fetched_at", F.col("fetched_at").cast("date"))
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["decision"], r["active"], r["list_id"]) for r in urlfilter.as_of(c, e).collect()), key=repr)
    assert got == sorted([(False, 7, "block", 3, "l"), (False, 7, "block", 3, "l"), (False, 2, "allow", 1, "l"), (False, 3, "allow", 1, "l"), (False, 4, "none", 0, None), (False, 5, "block", 3, "l"), (False, 6, "none", 0, None), (False, 7, "none", 0, None), (True, 0, "block", 3, "l"), (False, 8, "block", 3, "l")], key=repr)
