import json

from pyspark.sql import functions as F

from millrace.operators import report as R
from millrace.operators import select as S
from millrace.plans import flows as P
from millrace.plans import specs
from millrace.sources import scan


def test_levels_are_attempted_as_asked_or_as_answered(spark):
    scored = spark.createDataFrame([("a", "7", True, 0.5, 0.0, True, False, True, False), ("b", "7", False, 0.0, 0.0, False, False, False, False), ("c", "x", True, 1.0, 1.0, True, True, True, True)], "question_id string, answer string, l3_correct boolean, tiou double, viou double, l4_correct boolean, l5_correct boolean, has_temporal_gt boolean, has_spatial_gt boolean")
    pred = spark.createDataFrame([("a", "7", None, "7", None, ["1", "4", "?"]), ("b", None, "8", None, "[]", None), ("c", None, None, "x", None, None)], "question_id string, level1_answer string, level2_answer string, prediction string, temporal string, levels array<string>")
    rows = P.leveled(scored, pred).orderBy("question_id").collect()
    assert [[r[f"l{k}_attempted"] for k in range(1, 6)] for r in rows] == [[True, False, False, True, False], [False, True, False, True, False], [False, False, True, False, False]]
    assert [(r["l1_correct"], r["l2_correct"]) for r in rows] == [(True, None), (None, False), (None, None)]
    whole = R.whole_report(P.leveled(scored, pred)).first()
    assert whole["level1_accuracy"] == 100 and whole["level2_accuracy"] == 0 and whole["level4_attempted_count"] == 2 and whole["level4_correct_count"] == 1
    assert abs(whole["spatio_temporal_annotation_coverage"] - 100 / 3) < 1e-9 and whole["mean_viou_annotated"] == 100
    tagged = P.leveled(scored, pred).withColumns({"category": F.lit("k"), "capabilities": F.when(F.col("question_id") != "b", F.array(F.lit("see"), F.col("question_id")))})
    groups = {(r["dimension"], r["group"]): r["count"] for r in R.grouped_reports(tagged, ("category",)).collect()}
    assert groups == {("category", "k"): 3, ("capability", "see"): 2, ("capability", "a"): 1, ("capability", "c"): 1}
    assert R.whole_report(P.leveled(scored.limit(0), pred)).first()["count"] == 0


def test_filtering_keeps_errors_of_a_row_apart(spark):
    say = lambda *m: json.dumps([{"role": r, "content": c} for r, c in m])
    results = spark.createDataFrame([(k, f"q{k}", p, "task_complete", None) for k, p in enumerate(["", "A", "", "A", "B", ""])], "source_index long, id string, predicted string, exit_reason string, error string")
    items = spark.createDataFrame([(f"q{k}", "mcq", ["A"]) for k in range(5)], "id string, answer_type string, ground_truth array<string>")
    good = say(("user", "q"), ("assistant", "so <answer>A</answer>"))
    messages = spark.createDataFrame([(0, good), (1, good[:20]), (2, '{"role": "user"}'), (4, good), (5, good)], "source_index long, content string")
    report, rows = P.data_filter(results, items, messages, "call a tool")
    got = {r["source_index"]: (r["passed"], r["reason"]) for r in report.collect()}
    assert got[0] == (True, "exact_match") and got[1] == got[2] == (False, "row_error:bad_messages")
    assert got[3] == (True, "exact_match;no_item_dir") and got[4] == (False, "no_match_mcq") and got[5] == (False, "no_ground_truth")
    assert {r["source_index"] for r in rows.collect()} == {0}
    _, kept = P.data_filter(results, items, messages, "call a tool", keep_failed=True)
    assert {(r["source_index"], r["passed"]) for r in kept.collect()} == {(0, True), (4, False), (5, False)}


def test_archive(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    got = S.archived(spark.createDataFrame(rows, "k int, n int, v string"), ["k"], ["n"]).orderBy("k", "n").collect()
    assert [(r["v"], r["attempt"], r["attempts"], r["superseded"]) for r in got] == [("a", 1, 2, True), ("b", 2, 2, False), ("c", 1, 1, False)]


def test_items_and_prompts_of_a_benchmark(spark):
    files = spark.createDataFrame([("/x/items.json", json.dumps({"data": [{"question_id": 5, "question": "Which?", "options": ["one", "two"]}, 3, {"question_id": "q7", "question": "Where?", "video": "v"}, {"question_id": "q8", "question": "When?", "video": "v"}]}))], "path string, content string")
    rows = specs.items(files, "option_text")
    assert {r["question_id"]: r["source_index"] for r in rows.collect()} == {"5": 0, "q7": 2, "q8": 3}
    one = {r["id"]: r["prompt"] for r in specs.prompts(rows, "option_text").collect()}
    assert one["5"] == "Which?\n  A. one\n  B. two\n\nAnswer with <answer>A</answer>, one option letter." and one["q7"].startswith("Where?\n\nAnswer")
    group = {r["id"]: r["prompt"] for r in specs.prompts(rows.filter("video is not null"), "exact_answer").collect()}
    assert group["v"].startswith("1. Where?\n2. When?\n\n")
    assert scan.json_items(files).count() == 3


def test_clipping_labels_and_required_matches(spark):
    import pytest

    from millrace.operators import intervals as I  # noqa: E741
    from millrace.operators import joins as J

    truth = spark.createDataFrame([("a", 1, 100, 200), ("a", 2, 1000, 1100), ("b", 3, 0, 10)], "k string, _id int, s int, e int")
    found = spark.createDataFrame([("a", 90, 150), ("a", 140, 215), ("a", 300, 300)], "k string, s int, e int")
    got = {r["_id"]: r["clipped_iou"] for r in I.clipped_iou(truth, found, ["k"], 10).collect()}
    assert got == {1: pytest.approx(120 / 125), 2: 0.0}  # of 125 found, 120 in 90 to 210
    labels = spark.createDataFrame([(1, "x", 3), (1, "y", 1), (1, "x", 5), (1, "y", 2), (2, "z", 0)], "r int, label string, place int")
    m = spark.createDataFrame([("p", 1), ("q", 2), ("s", 9)], "l string, r int")
    assert {r["l"]: r["label"] for r in J.dominant_label(m, labels, "l", "r", "label", "place").collect()} == {"p": "y", "q": "z", "s": None}
    pred = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, p string")
    true = spark.createDataFrame([(1, "x"), (3, "x")], "k int, t string")
    assert {tuple(r) for r in J.labelled_pairs(pred, true, "k", "p", "t").collect()} == {("x", "x", 1), ("x", "MISSING", 1), ("y", "x", 1)}
    assert tuple(J.required_match(J.matched(pred.select("k"), true.select("k"), "k")).first()) == (3, 2, 1)
    with pytest.raises(Exception, match="no key matched"):
        J.required_match(J.matched(pred.select("k"), true.filter("k > 5").select("k"), "k")).collect()
