import random


import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import conversation as C
from millrace.operators import intervals as I  # noqa: E741
from millrace.operators import joins as J
from millrace.operators import metrics as M
from millrace.operators import quality as Q
from millrace.operators import report as R
from millrace.operators import reward as W
from millrace.operators import select as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_advantages_of_a_group(spark):
    df = spark.createDataFrame([(1, 0, 1.0, False), (1, 1, 0.0, True), (1, 2, 0.0, False), (1, 3, 1.0, False)], "g int, i int, reward double, removed boolean")
    assert [r["advantage"] for r in W.centred(df, "g").orderBy("i").collect()] == pytest.approx([1 / 3, 0, -2 / 3, 1 / 3])
    assert tuple(W.group_filter(df, "g").first())[1:] == (False, "removed_1")
    kept = spark.createDataFrame([(1, 1.0, False), (1, 0.0, False), (1, 0.2, False), (1, 1.0, False)], "g int, reward double, removed boolean")
    assert W.group_filter(kept, "g").first()["keep"]


def test_length_penalty(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 1.0, 3), (1, 2, 1.0, 1.0, 6), (1, 3, -0.2, 0.0, 10)], "g int, i int, score double, correctness double, num_steps int")
    df = df.withColumns({"removed": F.lit(False), "modality_match": F.lit(True), "n_tool": F.lit(1)})
    got = [x for r in W.length_shaped(df, "g").orderBy("i").collect() for x in (r["length_factor"], r["score"])]
    assert got == pytest.approx([1.0, 1.0, 0.8, 0.8, 1.0, -0.2])


def test_scores(spark):
    def score(prediction, exit_reason, n_tool, **k):
        p, t = F.lit(prediction).cast("string"), F.array(F.lit("yes"))
        s = W.score(W.outcome(p, t), F.lit(k.get("ok", True)), F.lit(k.get("media", False)), F.lit(n_tool), F.lit(k.get("fail", 0)), F.lit(k.get("escape", 0)), W.format_value(F.lit(exit_reason), p), W.removed(F.lit(exit_reason), p))
        return spark.range(1).select(s.alias("s")).first()["s"]["score"]

    assert score("Yes", "task_complete", 0) == pytest.approx(0.2)
    assert score("Yes", "task_complete", 1) == pytest.approx(1.0)
    assert score(None, "timeout", 1) == 0.0
    assert score("no", "timeout", 1, media=True, ok=False) == pytest.approx(-0.5)
    assert score("yes", "task_complete", 1, fail=1, escape=1) == pytest.approx(0.2 - 0.25)


def test_modality_of_shared_file(spark):
    v, a = F.array(F.lit("x.mp4")), F.array(F.lit("x.mp4"))
    m = lambda v, a, n: tuple(spark.range(1).select(W.modality(v, a, n, ("ffmpeg",), ("sox",), ()).alias("m")).first()["m"])
    assert m(v, a, F.array(F.lit("ffmpeg"))) == (True, True, False)
    assert m(v, F.array(F.lit("y.wav")), F.array(F.lit("ffmpeg"))) == (False, True, True)


def test_escapes_and_call_faults(spark):
    calls = spark.createDataFrame([(1, "execute_commands", False, "cat /tmp/a"), (1, "rm", False, "x"), (1, None, True, None), (1, "execute_commands", False, "curl http://x; cat /etc/passwd"), (1, "execute_commands", False, "cat answer_key.json / b")], "t int, name string, bad boolean, text string")
    none = spark.createDataFrame([], "t int, role string, text string")
    got = W.tool_summary(calls, none, "t", "/work", malformed="bad", text="text").first()
    assert (got["n_tool"], got["n_unparseable"], got["n_disallowed"], got["n_escape"]) == (5, 1, 2, 2)


def test_inventory_prefers_later_path_and_reports_missing(spark):
    c = spark.createDataFrame([("b", "0", True, True, 1, "a_job"), ("b", "0", True, True, 1, "z_job"), ("b", "1", True, False, 1, "x"), ("b", "2", None, True, 1, "x")], "benchmark string, item_id string, correct boolean, complete boolean, attempt int, path string")
    chosen, summary = R.inventory(c, [F.desc("attempt"), F.desc("path")])
    assert [r["path"] for r in chosen.collect()] == ["z_job"]
    s = summary.first()
    assert (s["candidate_rows"], s["unique_items"], s["selected"], s["missing_ids"], s["unscored_candidate_rows"]) == (4, 3, 1, ["1"], 1)


def test_accuracy_report_with_null_verdicts(spark):
    df = spark.createDataFrame([("a", True, "x", 1), ("a", None, "", 2), (None, False, None, 3)], "k string, is_correct boolean, prediction string, tool_call_num int")
    got = {(r["level"], r["group"]): (r["count"], r["accuracy"], r["non_empty_ratio"]) for r in M.accuracy_report(df, ["k"]).collect()}
    assert got == {("overall", None): (3, 0.5, pytest.approx(1 / 3)), ("k", "a"): (2, 1.0, 0.5)}


def test_agreement(spark):
    df = spark.createDataFrame([("a", "a")] * 4 + [("b", "b")] * 4 + [("a", "b")] * 2, "t string, f string")
    assert M.cohen_kappa(df, "t", "f").first()["kappa"] == pytest.approx((0.8 - 0.48) / (1 - 0.48))
    assert M.cohen_kappa(df.limit(3), "t", "f").first()["kappa"] == 0.0
    same = spark.createDataFrame([("a", "a")] * 6, "t string, f string")
    assert M.cohen_kappa(same, "t", "f").first()["kappa"] == 1.0
    q = spark.createDataFrame([(0, 0), (3, 3), (1, 2), (2, 2)], "a int, b int")
    x, y = np.array([0, 3, 1, 2]), np.array([0, 3, 2, 2])
    wanted = 1 - ((x - y) ** 2).sum() / ((x[:, None] - y[None, :]) ** 2).sum() * 4
    assert M.quadratic_kappa(q, "a", "b").first()["kappa"] == pytest.approx(wanted)
    assert M.macro_f1(M.class_counts(df, "t", "f")).first()["macro_f1"] == pytest.approx((8 / 10 + 8 / 10) / 2)


def test_zero_rules_of_f1(spark):
    c = spark.createDataFrame([("a", 1, 0, 0), ("b", 0, 0, 0)], "label string, tp int, fp int, fn int")
    assert [M.macro_f1(c, z).first()["macro_f1"] for z in ("skip", "zero", "one")] == [1.0, 0.5, 1.0]


def test_medians_and_ranks(spark):
    df = spark.range(1, 5)
    r = M.order_statistics(df, [], "id", {"m": M.upper_median, "p": M.nearest_rank(0.9)}).first()
    assert (r["m"], r["p"]) == (3, 4)
    repeated = spark.createDataFrame([("a", x) for x in (5, 1, 1, None, 9, 9, 9)] + [("b", 2), ("c", None)], "k string, x int")
    got = {r["k"]: (r["m"], r["p"]) for r in M.order_statistics(repeated, ["k"], "x", {"m": M.upper_median, "p": M.nearest_rank(0.5)}).collect()}
    assert got == {"a": (9, 5), "b": (2, 2)}
    assert M.order_statistics(df.limit(0), [], "id", {"m": M.upper_median}).first()["m"] is None
    assert df.filter("id = 1").agg(M.variation("id").alias("v")).first()["v"] == 100.0


def test_score_tokens():
    assert M.score_tokens('He said: "no, 3.5-4 &amp; more."\n(x-y)') == ["He", "said", ":", '"', "no", ",", "3.5", "-", "4", "&", "more", ".", '"', "(", "x-y", ")"]


def test_bleu_is_one_for_equal_texts(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat")], "h string, r string")
    assert M.corpus_bleu(df, "h", "r").first()["bleu"] == pytest.approx(1.0)
    assert M.corpus_bleu(df.limit(0), "h", "r").first()["bleu"] == 0.0


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 9), (1, 10, 12)], "k int, s int, e int")
    assert rows(I.merge(df, ["k"], "s", "e"), "s") == [(1, 0, 7, 2), (1, 10, 12, 1)]
    other = spark.createDataFrame([(1, 4, 11)], "k int, s int, e int")
    r = I.temporal_iou(df, other, ["k"], width=4).first()
    assert (r["common"], r["tiou"]) == (4, pytest.approx(4 / 12))
    assert I.temporal_iou(df, other.limit(0), ["k"]).first()["tiou"] == 0.0
    assert I.max_concurrent(df, ["k"], "s", "e").first()["most_open"] == 2
    t = I.interpolate(spark.createDataFrame([(1, 0, 0.0), (1, 10, 5.0)], "k int, t int, v double"), spark.createDataFrame([(1, -3), (1, 4), (1, 10), (1, 99)], "k int, t int"), ["k"], "t", "v")
    assert [r["interpolated"] for r in t.orderBy("t").collect()] == [0.0, 2.0, 5.0, 5.0]


def test_nearest_ties_and_as_of(spark):
    a = spark.createDataFrame([(1, 1, 10)], "_id int, k int, t int")
    b = spark.createDataFrame([(1, 8, 5), (1, 12, 4), (1, 99, 1)], "k int, t2 int, o int")
    assert J.nearest(a, b, ["k"], "t", "t2", 5, "o", ["o"]).first()["near"]["o"] == 4
    assert J.nearest(a, b, ["k"], "t", "t2", 1, "o", ["o"]).first()["near"] is None
    assert J.as_of(a, b, ["k"], "t", "t2", "o").first()["o"] == 5
    assert J.as_of(a, b, ["k"], "t", "t2", "o", 1).first()["o"] is None


def test_selection(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 2, 3)], "k int, attempt int, o int")
    assert S.latest_per_key(df, ["k"], "attempt", "o").first()["o"] == 3
    assert [r["k"] for r in spark.createDataFrame([("b",), ("10",), ("9",)], "k string").orderBy(*S.numeric_first(F.col("k"))).collect()] == ["9", "10", "b"]
    assert S.member_filter(df, "k", []).count() == 3
    w = S.weighted_rotation(spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "n string, w int"), "n", "w")
    assert [r["n"] for r in w.orderBy("slot").collect()] == ["a", "a", "b", "a"]


def test_conversation_clean_up(spark):
    m = spark.createDataFrame([(1, 0, "system", "<answer>X</answer>"), (1, 1, "assistant", "first"), (1, 2, "assistant", "so <answer>B</answer>")], "c int, p int, role string, text string")
    assert C.last_answer(m, "c", "p", "role", "text", "CHECK").first()["answer"] == "B"
    t = C.with_terminal(C.collapse_assistants(m, "c", "p", "role"), "c", "p", "role", "text")
    assert [r["role"] for r in t.orderBy("p").collect()][-3:] == ["assistant", "tool_call", "tool_response"]
    again = C.with_terminal(t, "c", "p", "role", "text")
    assert again.filter("role = 'tool_call'").count() == 1
    call = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "done "), (1, 2, "tool_call", C.DONE)], "c int, p int, role string, text string")
    ans = spark.createDataFrame([(1, "B")], "c int, answer string")
    got = C.with_answer_inside(call, ans, "c", "p", "role", "text").orderBy("p").collect()
    assert got[1]["text"] == "done\n\n<answer>B</answer>"
    bare = C.with_answer_inside(call.filter("p <> 1"), ans, "c", "p", "role", "text").orderBy("p").collect()
    assert [r["role"] for r in bare] == ["user", "assistant", "tool_call"]


def test_image_pairs_by_ordinal(spark):
    m = spark.createDataFrame([(1, 0, "assistant", ""), (1, 1, "tool_call", '{"name": "image_read"}'), (1, 2, "tool_call", '{"name": "task_complete"}'), (1, 3, "tool_response", "img"), (1, 4, "tool_response", "")], "c int, p int, role string, text string")
    assert rows(C.paired_images(m, "c", "p", "role", "text"), "call_place") == [(1, 1, 3)]


def test_quality(spark):
    df = spark.createDataFrame([(1, "password: hunter2"), (2, "fine")], "id int, t string")
    assert [r["id"] for r in Q.secrets(df, ["t"]).collect()] == [1]
    assert Q.schema_difference(["a", "b"], ["b", "c"]) == (["c"], ["a"])
    assert Q.unique_ids(df, "id").first()["unique"]


def test_speaker_errors(spark):
    truth = spark.createDataFrame([(1, 0, 2000, "a", 0)], "k int, s int, e int, label string, ordinal int")
    found = spark.createDataFrame([(1, 0, 1000, "a", 0), (1, 1000, 2000, "b", 1)], "k int, s int, e int, label string, ordinal int")
    r = M.speaker_error_rate(truth, found, ["k"]).first()
    assert r["error_rate"] == pytest.approx(16 / 31)


def test_speaker_errors_of_long_turns_make_no_row_for_each_time(spark):
    import random

    rng = random.Random(5)
    turn = lambda k: (rng.choice([1, 1, 2, None]), s := rng.randrange(-9000, 20000), s + rng.choice([0, 40, 700, rng.randrange(15000)]), rng.choice(["a", "b", "c", None]), k if rng.random() < 0.9 else None)
    kinds = "k int, s int, e int, label string, ordinal int"
    rows = [[turn(k) for k in range(60)] for _ in range(2)]
    truth, found = (spark.createDataFrame(r, kinds) for r in rows)
    for collar in (0, 250):
        got = {r["k"]: (r["samples"], r["error_rate"]) for r in M.speaker_error_rate(truth, found, ["k"], collar=collar).collect()}
        want = {}
        for key in (1, 2, None):
            errors = []
            for t in range(-9000, 36000, 50):
                true = [x[3] for x in rows[0] if x[0] == key and x[1] <= t < x[2] and t - x[1] >= collar and x[2] - t >= collar]
                said = [(x[4], x[3]) for x in rows[1] if key is not None and x[0] == key and x[1] <= t < x[2] and x[4] is not None]
                if true:
                    errors.append(min((x for x in true if x), default=None) != (min(said)[1] if said else None))
            want[key] = (len(errors), pytest.approx(sum(errors) / len(errors)))
        assert got == want
    long_turn = spark.createDataFrame([(1, 0, 10_000_000_000, "a", 0)], kinds.replace("int", "long"))
    assert M.speaker_error_rate(long_turn, long_turn, ["k"]).first()[1:] == (199_999_991, 0.0)


def test_groups_by_rules_of_ones_own(spark):
    rows = [("a", 1.0, False), ("a", 0.0, False), ("b", 1.0, False), ("b", 1.0, False), ("c", 1.0, True), ("c", 0.0, False), ("d", 1.0, False), ("e", 1.0, False), ("e", 0.0, False), ("e", 0.5, False)]
    df = spark.createDataFrame(rows, "g string, reward double, removed boolean")
    rules = [*W.group_rules(), (F.count("*") > 2, F.lit("large"))]
    got = {r["g"]: (r["keep"], r["reason"]) for r in W.group_filter(df, "g", rules=rules).collect()}
    assert got == {"a": (True, None), "b": (False, "zero_std_1.0"), "c": (False, "removed_1"), "d": (False, "active_1"), "e": (False, "large")}
    assert sorted(r["advantage"] for r in W.trained_on(df, "g", rules).collect()) == [-0.5, 0.5]
    assert W.trained_on(df, "g", [], lambda d, g: d.filter("reward > 0")).count() == 7


def test_nearest_places_equal_all_pairs(spark):
    """Dense and sparse parts, equal places, ties by name, places at the very radius, and places without a coordinate."""
    rng = random.Random(9)
    place = lambda: (rng.choice([0.0, 50.0]) + rng.randrange(40) / 8, rng.randrange(40) / 8) if rng.random() < 0.8 else (rng.uniform(-60, 60), rng.uniform(-60, 60))
    a = [(k, *place()) for k in range(300)] + [(1000, None, 1.0), (1001, 200.0, 0.0), (1002, 0.0, float("nan"))]
    b = [(k, *place()) for k in range(900)] + [(1000, 202.0, 0.0), (1001, None, None)]
    rows = lambda r, names: spark.createDataFrame(r, f"{names[0]} long, {names[1]} double, {names[2]} double")
    got = {r["_id"]: (r["squared"], r["name"]) for r in J.radius_nearest(rows(a, ("_id", "x", "y")), rows(b, ("name", "x2", "y2")), 2.0).collect()}
    far = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 if None not in p + q else float("inf")
    for p in a:
        best = min((far(p, q), q[0]) for q in b) if p[0] != 1002 else (float("inf"), 0)
        assert got[p[0]] == (best if best[0] <= 4.0 else (None, None))


def test_nearest_of_many_equal_places_makes_no_pairs_of_rows(spark):
    k = F.col("id")
    a, b = spark.range(300_000).select(k.alias("_id"), (k % 2).cast("double").alias("x"), F.lit(0.0).alias("y")), spark.range(300_000).select(k.alias("name"), (k % 3).cast("double").alias("x2"), F.lit(0.0).alias("y2"))
    got = J.radius_nearest(a, b, 2.0).groupBy("x", "name", "squared").count().collect()
    assert sorted(map(tuple, got)) == [(0.0, 0, 0.0, 150_000), (1.0, 1, 0.0, 150_000)]
