import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import graders as G
from millrace.operators.stepwise import Steps
from millrace.sources import formats
from millrace.streaming import replay as R


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


def read(spark, name, path, schema=None, **options):
    r = spark.read.format(name).options(**options)
    return (r.schema(schema) if schema else r).load(str(path))


def test_gauges(known, tmp_path):
    (tmp_path / "a.prom").write_text('# HELP x\nm{tp_rank="0",x="a \\"b\\", c"} 1.5\n\nn 3e1 1700000000\nbroken{x="} 1\nalone\nz +Inf\n')
    (tmp_path / "_skipped").write_text("m 1\n")
    got = [tuple(r) for r in read(known, "prometheus_text", tmp_path).orderBy("line").select("line", "metric", "labels", "value", "bad").collect()]
    assert got == [(2, "m", {"tp_rank": "0", "x": 'a \\"b\\", c'}, 1.5, None), (4, "n", {}, 30.0, None), (5, None, None, None, 'broken{x="} 1'), (6, None, None, None, "alone"), (7, "z", {}, float("inf"), None)]


def test_subtitles_and_events(known, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02.500\nHello\nthere\n\n\nbroken\nblock\n\n2\n01:00:03,25 --> 01:00:04,000\nBye")
    got = [tuple(r)[1:] for r in read(known, "subtitles_srt", tmp_path).orderBy("place").collect()]
    assert got == [(0, 1.0, 2.5, "Hello there", None), (1, None, None, None, "broken\nblock"), (2, 3603.25, 3604.0, "Bye", None)]
    (tmp_path / "log.txt").write_text('{"a": 1}\nnoise\n\n[1]\n{"b": "é"}\n')
    got = [tuple(r)[1:] for r in read(known, "agent_events", tmp_path, glob="*.txt").orderBy("line").collect()]
    assert got == [(1, '{"a": 1}', None), (2, None, "noise"), (4, None, "[1]"), (5, '{"b": "é"}', None)]


def test_many_files_and_none(known, tmp_path):
    assert read(known, "agent_events", tmp_path).count() == 0
    for k in range(40):
        (tmp_path / f"{k}.jsonl").write_text("".join(f'{{"k": {k}, "i": {i}}}\n' for i in range(k)))
    df = read(known, "agent_events", tmp_path, partitionBytes=2000)
    assert df.count() == sum(range(40)) and df.rdd.getNumPartitions() > 3
    assert df.select("path").distinct().count() == 39


def test_bad_shards_are_told_and_the_rest_is_read(known, tmp_path):
    rows = [{"id": k, "name": f"n{k}"} for k in range(5000)]
    known.createDataFrame([(r["id"], r["name"]) for r in rows], "id long, name string").coalesce(1).write.parquet(str(tmp_path / "good"))
    whole = next((tmp_path / "good").glob("*.parquet")).read_bytes()
    (tmp_path / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "none.parquet").write_bytes(b"")
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows[:10]))
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": 2, "na')
    packed = gzip.compress("".join(json.dumps(r) + "\n" for r in rows).encode())
    (tmp_path / "c.jsonl.gz").write_bytes(packed)
    (tmp_path / "d.jsonl.gz").write_bytes(packed[:-40])
    (tmp_path / "e.jsonl").write_bytes(b'{"id": 1, "name": "\xff"}\n')
    (tmp_path / "f.jsonl").write_text("")
    got = read(known, "checked_shards", tmp_path, "id long, name string, path string, error string")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    good = {r[0].split(".", 1)[0][:4]: r[1] for r in got.filter("error is null").groupBy(name).count().collect()}
    bad = {r[0] for r in got.filter("error is not null and id is null").select(name).collect()}
    assert good == {"part": 5000, "a": 10, "c": 5000} and bad == {"cut.parquet", "none.parquet", "b.jsonl", "d.jsonl.gz", "e.jsonl"}
    assert got.filter("error is null").agg(F.sum("id")).first()[0] == 2 * sum(range(5000)) + 45


def test_a_stream_reads_each_file_once(known, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(5):
        (src / f"{k}.prom").write_text(f"m {k}\n")
        time.sleep(0.01)
    stream = known.readStream.format("prometheus_text").load(str(src))

    def run():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(r["value"] for r in known.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [0.0, 1.0, 2.0, 3.0, 4.0]
    (src / "9.prom").write_text("m 9\n")
    assert run() == [0.0, 1.0, 2.0, 3.0, 4.0, 9.0]


def test_a_grader_is_a_table_function(spark):
    row = lambda task, kind, a=None, b=None, flag=None, n=None: (task, kind, a, b, flag, n)
    rows = [row("x", "truth", f"A-{k}", f"B-{k}", k < 2) for k in range(4)]
    rows += [row("x", "match", f" A-{k}"[k == 0 :], f"B-{k}", k == 0) for k in range(3)] + [row("x", "match", "A-9", "B-9"), row("x", "match", "", "B-1"), row("x", "unmatched", "b", "B-7"), row("x", "chart", "1280", "720"), row("x", "report", n=10)]
    rows += [row("x", "axis", flag=k < 3) for k in range(4)]
    rows += [row("y", "truth", "A-1", "B-1"), row("y", "match", "A-1", "B-1"), row("y", "unmatched", "A", "A-1"), row("y", "report", n=400)]
    df = spark.createDataFrame(rows, "task string, kind string, a string, b string, flag boolean, n int")
    got = {(r["task"], r["dim"]): (r["value"], r["ok"]) for r in G.graded(df, G.Reconciliation, "task").collect()}
    assert got["x", "match_recall"] == (0.75, True) and got["x", "match_precision"] == (0.75, False) and got["x", "price_anomaly_recall"] == (0.5, False)
    assert got["x", "report_axes"] == (0.75, True) and got["x", "chart_size"] == (None, True) and not got["x", "cross_doc_consistency"][1]
    assert got["y", "match_recall"] == (1.0, True) and got["y", "price_anomaly_recall"] == (0.0, False) and not got["y", "cross_doc_consistency"][1] and not got["y", "chart_size"][1]
    score = {r["task"]: (r["score"], r["passed"]) for r in G.weighed(G.graded(df, G.Reconciliation, "task"), "task", G.Reconciliation.WEIGHTS, G.Reconciliation.FLAGS).collect()}
    assert score["x"] == (pytest.approx(0.18 * 0.75 * 2 + 0.22 * 0.5 + 0.07 + 0.15 * 0.75), False) and score["y"][0] == pytest.approx(0.36)
    assert G.graded(df.limit(0), G.Reconciliation, "task").count() == 0
    df.createOrReplaceTempView("grader_rows")
    spark.udtf.register("reconcile", G.table_function(G.Reconciliation, "task", "string"))
    lateral = spark.sql("SELECT t.task, g.dim FROM (SELECT DISTINCT task FROM grader_rows) t JOIN reconcile(TABLE(grader_rows) PARTITION BY task) g ON t.task = g.task")
    assert lateral.count() == 12


def test_a_case_of_any_size_is_counted_before_python(spark):
    row = lambda task, kind, a=None, b=None, flag=None, n=None: (task, kind, a, b, flag, n)
    rows = [row(t, "truth", f"A-{k}", f"B-{k}\u2003", k % 3 == 0 or None) for t in ("x", None) for k in range(400)] + [row("x", "truth", "A-1", "B-1", True)]
    rows += [row(t, "match", f"A-{k}" + " \t" * (k % 2), f"B-{k}", k % 2 == 0) for t in ("x", None) for k in range(500)] + [row("x", "match", None, "B-1"), row("x", "match", "a-1", "B-1", True)] * 2
    rows += [row("x", "unmatched", " b\x1f", f"B-{k}") for k in range(490, 600)] + [row("x", "unmatched", "C", None), row("x", "report", n=321), row("x", "report"), row("x", "axis", flag=None), row("x", "axis", flag=True), row("x", None), row("z", "truth")]
    rows += [row("x", "chart", " 1280", "720"), row("w", "chart", "1", "2"), row("w", "match"), row("w", "report", n=320)]
    df = spark.createDataFrame(rows, "task string, kind string, a string, b string, flag boolean, n int")
    few = G.Reconciliation.counted(df, "task")
    assert max(r["n_rows"] for r in few.groupBy("task").agg(F.count("*").alias("n_rows")).collect()) <= 14
    plain = G.table_function(G.Reconciliation, "task", "string")(df.asTable().partitionBy("task"))
    assert sorted(map(repr, G.graded(df, G.Reconciliation, "task").collect())) == sorted(map(repr, plain.collect()))


def test_replay_keeps_the_order_of_parts(spark):
    rows = spark.range(0, 1000).select("id", (F.col("id") * 7 % 1000).alias("at"))
    steps = Steps(spark, "replay-test")
    stream = R.replayed(rows, "at", 4, steps, [F.lit(-1).cast("long").alias("id"), F.lit(5000).cast("long").alias("at")])
    out = R.finished(stream, "update", steps)
    by = {r["epoch"]: (r["lo"], r["hi"]) for r in out.groupBy("epoch").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect()}
    assert out.count() == 1001 and len(by) >= 4
    assert all(by[k][1] < by[k + 1][0] for k in range(len(by) - 1))
