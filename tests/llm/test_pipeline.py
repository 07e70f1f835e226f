import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as P  # noqa: E402
from millrace.llm.language import identified  # noqa: E402
from millrace.llm.minhash import near_duplicates  # noqa: E402
from millrace.llm.mixing import mixed  # noqa: E402
from millrace.llm.repeats import repeated  # noqa: E402

from tests.llm.test_pairs_and_repeats import linked, shingles  # noqa: E402

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    given = docs.count()
    assert [n for n, _ in P.STAGES] == ["language", "near_dedup", "repeats", "mixing", "packing"]
    out = {}
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == P.COLUMNS
        if name == "near_dedup":
            kept = {r["doc_id"] for r in near_duplicates(before).filter("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == kept
        if name == "repeats":
            assert repeated(before).agg(F.sum(F.col("n_bytes") - F.col("n_removed")).alias("b")).first()["b"] >= docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"]
            assert docs.count() == before.count()
    assert out["language"].count() >= 0.98 * given
    assert out["packing"].select("doc_id").distinct().count() == out["mixing"].select("doc_id").distinct().count()


def test_run_is_the_stages(spark):
    rows = P.run(spark, DIR)
    assert rows.count() > 0 and "ids_crc32" in rows.columns


def removed(texts, length=200):
    """Texts without their repeated strings, byte by byte."""
    count = Counter(b[i : i + length] for t in texts for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore"))
    return out


@pytest.fixture(scope="module")
def odd(spark, documents):
    """Rows of every oddity, some twice, with columns whose names the stages use themselves."""
    docs = documents.drop("copies").withColumn("n_chars", F.char_length("text").cast("long"))
    docs = docs.unionAll(docs.filter("doc_id in (7, 100, 400, 404) or doc_id is null"))
    extra = {c: F.lit(1) for c in ("copies", "maybe", "grp", "size", "key", "row", "t1", "c0", "tie", "held_out", "kept_text", "start")}
    return docs.withColumns(extra)


def rows(df):
    return sorted((tuple(r) for r in df.select(*P.COLUMNS).collect()), key=repr)


def test_language_on_odd_rows(spark, odd):
    got, all_ = rows(P.language(spark, odd, DIR)), rows(odd)
    verdicts = Counter((r["doc_id"], r["rejected"]) for r in identified(odd).collect())
    assert Counter(r[0] for r in got) == Counter({d: n for (d, out), n in verdicts.items() if not out})
    assert all(r in all_ for r in got) and not any(r[1] is None or not any(c.isalpha() for c in r[1]) for r in got)


def test_near_dedup_on_odd_rows(spark, odd):
    got, all_ = rows(P.near_dedup(spark, odd, DIR)), rows(odd)
    sets = [shingles(r[1]) for r in all_]
    root = list(range(len(all_)))
    for i in range(len(all_)):
        for j in range(i):
            if sets[i] and linked(sets[i], sets[j]):
                root = [root[i] if r == root[j] else r for r in root]
    groups = {}
    for k, r in enumerate(all_):
        groups.setdefault(root[k], []).append(r)
    least = [min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()]
    assert Counter(r[0] for r in got) == Counter(least) and all(r in all_ for r in got)


def test_repeats_on_odd_rows(spark, odd):
    all_ = odd.select(*P.COLUMNS).collect()
    want = sorted(((r["doc_id"], t, r["lang"], r["source"], len(t)) for r, t in zip(all_, removed([r["text"] for r in all_]), strict=True)), key=repr)
    assert rows(P.repeats(spark, odd, DIR)) == want


def test_mixing_on_odd_rows(spark, odd):
    times = Counter()
    for r in mixed(odd, carry=("text",)).collect():
        times[r["doc_id"], r["text"]] += r["copies"]
    got = rows(P.mixing(spark, odd, DIR))
    assert Counter((r[0], r[1]) for r in got) == +times
    assert rows(P.mixing(spark, odd.repartition(5), DIR)) == got


def test_packing_on_odd_rows(spark, odd):
    from tokenizers import Tokenizer

    t, sums = Tokenizer.from_file(P.tokenizer_path()), Counter()
    for r in odd.select("doc_id", "text").collect():
        ids, at = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes(), 0
        while at < len(ids) // 4:
            n = min(1024, 1 << ((len(ids) // 4 - at).bit_length() - 1))
            sums[r["doc_id"], at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])] += 1
            at += n
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in P.packing(spark, odd, DIR).collect()) == sums


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_stages_on_an_empty_table(spark, odd, stage):
    assert stage(spark, odd.limit(0), DIR).count() == 0
    assert stage(spark, odd.filter("text is null"), DIR).count() >= 0
