import json

import pytest
from pyspark.sql import functions as F

from millrace.plans import specs
from millrace.sources import scan, sink
from millrace.streaming import live


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a" / "results.json").write_text(json.dumps({"results": [{"id": 1}, 7, {"id": 2}]}))
    (tmp_path / ".hidden" / "results.json").write_text("[]")
    (tmp_path / "a" / "bad.json").write_text('{"x": ')
    return tmp_path


def test_items(spark, folder):
    files = scan.visible(scan.whole_files(spark, str(folder), "results.json"))
    assert [(r["place"], json.loads(r["item"])["id"]) for r in scan.json_items(files).orderBy("place").collect()] == [(0, 1), (2, 2)]
    rows, bad = scan.normalized_results(scan.visible(scan.whole_files(spark, str(folder))))
    assert rows.count() == 2 and [r["path"].rpartition("/")[2] for r in bad.collect()] == ["bad.json"]
    with pytest.raises(Exception, match="no list in"):
        scan.json_items(scan.whole_files(spark, str(folder), "bad.json")).collect()


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\nnoise\n{"id": 2}\n')
    assert scan.json_lines(spark, str(tmp_path / "x.jsonl")).count() == 2
    assert [r["line"] for r in scan.event_log(spark, str(tmp_path / "x.jsonl")).orderBy("line").collect()] == [1, 4]
    with pytest.raises(Exception):  # noqa: B017
        scan.strict_json_lines(spark, str(tmp_path / "x.jsonl"), "id int").collect()
    (tmp_path / "y.jsonl").write_text('{"id": 1}\n{"id": 1}\n')
    with pytest.raises(Exception, match="repeated id 1"):
        scan.strict_json_lines(spark, str(tmp_path / "y.jsonl"), "id int", "id").collect()


def test_maps_csv_and_names(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"q1": {"a": 1}, "q2": {"question_id": "q9"}}))
    assert sorted(r["id"] for r in scan.id_map(scan.whole_files(spark, str(tmp_path), "m.json")).collect()) == ["q1", "q9"]
    (tmp_path / "t.csv").write_text("Clip ID,Start-Time (s)\n1,2\n")
    assert scan.canonical_csv(spark, str(tmp_path / "t.csv"), ["clip_id"]).columns == ["clip_id", "start_time_s"]
    with pytest.raises(ValueError, match="missing columns: x"):
        scan.canonical_csv(spark, str(tmp_path / "t.csv"), ["x"])
    assert scan.resolve(["My-Report.md", "b.csv"], "my_report.txt") == "My-Report.md"
    assert scan.resolve(["b.csv"], "c.csv") is None


def test_prometheus_and_subtitles(spark, tmp_path):
    text = spark.createDataFrame([('m{tp_rank="0",x="a"} 1.5',), ('m{tp_rank="1"} 2',), ("# HELP",), ("n 3e1",)], "value string")
    assert sorted((r["metric"], r["value"]) for r in scan.prometheus(text).collect()) == [("m", 1.5), ("n", 30.0)]
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\nbroken\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n")
    got = scan.subtitles(scan.whole_files(spark, str(tmp_path), "*.srt")).orderBy("place").collect()
    assert [(r["start"], r["end"], r["text"]) for r in got] == [(1.0, 2.5, "Hello there"), (3.0, 4.0, "Bye")]


def test_grades_and_artifacts(spark, tmp_path):
    for name, body in (("t1", '{"pass": true, "score_so_far": 0.8}'), ("t2", "not-json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "grade.json").write_text(body)
    expected = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "task string")
    got = {r["task"]: (r["passed"], r["score"]) for r in scan.grades(expected, scan.whole_files(spark, str(tmp_path), "grade.json")).collect()}
    assert got == {"t1": (True, 0.8), "t2": (None, None), "t3": (None, None)}
    assert [r["parses"] for r in scan.artifacts(scan.whole_files(spark, str(tmp_path))).orderBy("path").collect()] == [True, False]


def test_prompt_rows(spark, tmp_path):
    rec = spark.createDataFrame([(1, "Which?", "mcq", ["A"], ["first", "second"], "fixture")], "id int, question string, answer_type string, ground_truth array<string>, options array<string>, source string")
    sink.prompts(rec, str(tmp_path / "p"))
    row = spark.read.parquet(str(tmp_path / "p")).first()
    assert "A. first" in row["prompt"] and json.loads(row["metadata"])["task_id"] == "fixture:1" and json.loads(row["label"]) == ["A"]
    assert sink.dataset(rec, str(tmp_path / "d"), "id").first()["rows"] == 1
    assert bytes(sink.decoded(spark.createDataFrame([("data:image/png;base64,aGk=",)], "b string"), "b").first()["bytes"]) == b"hi"


def test_specs(spark):
    assert specs.names()[0] == "exact_answer"
    with pytest.raises(KeyError, match="unknown benchmark"):
        specs.spec("nope")
    rows = spark.createDataFrame([("Final Answer: 8.0", None, "8")], "text string, options array<string>, truth string")
    assert specs.rescored(rows, "exact_answer").first()["new_correct"]
    assert specs.rescored(rows, "open_answer").first()["new_correct"] is None


def test_streams_agree_with_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"id": k * 4 + i, "k": "ab"[i % 2], "ok": i % 3 == 0}) for i in range(4)))
    schema = "id long, k string, ok boolean"
    q = live.to_memory(live.running_report(live.stream(spark, str(src), schema), "k", "ok"), "report", "complete")
    q.awaitTermination(60)
    want = live.running_report(spark.read.schema(schema).json(str(src)), "k", "ok")
    assert sorted(map(tuple, spark.table("report").collect())) == sorted(map(tuple, want.collect()))
    q = live.upserted(live.stream(spark, str(src), schema), str(tmp_path / "store"), "k", "id", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted((r["k"], r["id"]) for r in spark.read.parquet(str(tmp_path / "store" / "2")).collect()) == [("a", 10), ("b", 11)]


def test_coalescer_batches(spark):
    log = spark.createDataFrame([(0, i, t) for i, t in enumerate([0, 1, 2, 3, 50])], "log int, o int, t int")
    got = live.batches_of(log, 2, "o", "t", 10)
    assert [r["batch"] for r in got.orderBy("o").collect()] == [0, 0, 1, 1, 2]
    assert got.filter(F.col("batch") > 2).count() == 0


def test_resolution_by_join_equals_the_plain_one(spark):
    names = ["My-Report.md", "my_report.TXT", "b.csv", "b.CSV", "a.bin", "noext", "x.y.json", ".md", "Ünder.txt"]
    asked = ["my_report.txt", "My-Report.md", "MYREPORT.json", "b.Csv", "B.bin", "a.md", "A.BIN", "noext", "other", "xy.md", "x-y.json", "", "nder.csv", None]
    files = spark.createDataFrame([(n, 1) for n in names] + [("b.csv", 2)], "name string, place int")
    wanted = spark.createDataFrame([(a, k) for a in asked for k in (1, 2, 3)] * 2, "wanted string, place int")
    got = {(r["place"], r["wanted"]): r["name"] for r in scan.resolved(wanted, files, ["place"]).collect()}
    assert len(got) == 3 * len(asked)
    for k, there in ((1, names), (2, ["b.csv"]), (3, [])):
        for a in asked:
            assert got[k, a] == (None if a is None else scan.resolve(there, a)), (k, a)


def test_names_without_a_key_are_not_joined(spark):
    files = spark.createDataFrame([("d", "a.bin"), ("d", "b.txt")], "folder string, name string")
    wanted = spark.createDataFrame([("d", "A.bin"), ("d", "x.bin"), ("d", "b.md"), ("d", None)], "folder string, wanted string")
    got = scan.resolved(wanted, files, ["folder"])
    assert sorted((r["wanted"] or "", r["name"] or "") for r in got.collect()) == [("", ""), ("A.bin", "a.bin"), ("b.md", "b.txt"), ("x.bin", "")]
    assert "isnotnull(key" in got._jdf.queryExecution().optimizedPlan().toString() and "(tier#" in got._jdf.queryExecution().optimizedPlan().toString()
