import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from millrace.llm import importance as I
from millrace.llm.importance import resampled

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, percent=5, least=20):
    """By dictionaries: (doc_id, n_features, weight, score, rank) of each row, in input order."""

    def features(text):
        ws = WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))))
        return len(ws), [zlib.crc32(b" ".join(ws[i - k : i + 1])) % 10000 for i in range(len(ws)) for k in range(3) if i >= k]

    s, t = np.zeros(10000, int), np.zeros(10000, int)
    found = [(d, *features(x)) for d, x in docs]
    for _, _, f in found:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, features(x)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((k for k, r in enumerate(out) if r[5] >= least), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, k in enumerate(fit[: percent * len(fit) // 100], 1):
        out[k][4] = rank
    return [tuple(r[:5]) for r in out]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_equal_to_plain_counting(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    target = [" ".join(rows[k][1].split()[:40]) for k in (3, 5, 7)] + [None, ""]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in resampled(documents, aim, percent=30).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, target, percent=30), key=key)
    assert [tuple(r) for r in resampled(documents.repartition(5), aim, percent=30).orderBy("rank", "doc_id", "score").collect()] == sorted(got, key=lambda r: (r[4] is not None, r[4] or 0, r[0] is not None, r[0] or 0, r[3]))


def test_odd_texts(spark, monkeypatch):
    """Case, other scripts, control characters, one very long word, and texts cut into parts."""
    rng = np.random.default_rng(3)
    long = " ".join("w%d" % k for k in rng.integers(0, 500, 20_000))
    texts = ["A b-C_d\x7fe\x00F", "Ünï ÜNÏ naïve ß İ", "x" * 3000 + " " + "y" * 65 + "," + "z" * 64, "é" * 400, long, " ".join("ab" * 40 for _ in range(50)), None, "", "...", "日本語 テスト 日本語", "a " * 19, "a " * 20]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a " * 25), (None, None), (5, long), (5, long)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, rank string")
    aim = spark.createDataFrame([(long[:500],), ("ünï a b",)], "text string")
    want = sorted(plain(rows, [long[:500], "ünï a b"], percent=60), key=key)
    assert sorted((tuple(r) for r in resampled(docs, aim, percent=60).collect()), key=key) == want
    buf = np.frombuffer(long.encode(), np.uint8)
    crc, size, first = I._text_words(buf, np.array([0, len(buf)]))
    whole, _ = I.run_buckets(crc, size, first, 3, 10_000)
    monkeypatch.setattr("millrace.llm.kernel.PIECE", 1000)
    parts = list(I._long_text(buf, 3, 10_000))
    assert len(parts) > 50 and sum(n for n, _ in parts) == len(crc) and np.array_equal(np.concatenate([s for _, s in parts]), whole)


def test_nothing_to_draw_from(spark, documents):
    aim = spark.createDataFrame([], "text string")
    assert resampled(documents.limit(0), aim).count() == 0
    got = resampled(documents.filter("text is null"), aim).collect()
    assert [(r["n_features"], r["weight"], r["rank"]) for r in got] == [(0, 0, None)]
    same = spark.createDataFrame([(7, "a b c d e f g h i j k l m n o p q r s t u")] * 40, "doc_id long, text string")
    assert sorted(r["rank"] for r in resampled(same, aim).collect() if r["rank"]) == [1, 2]
    with pytest.raises(ValueError, match="16-bit"):
        resampled(documents, aim, buckets=70_000)
