import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import nested as N
from millrace.operators import records as E
from millrace.operators import reward as W
from millrace.plans import flows as P


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("record", "wanted"), [('{"a": null, "b": 1}', None), ('{"b": 1}', "1"), ('{"runs": {"level3": {"parsed_answer": "x"}}}', "x"), ('{"answer": "y", "runs": {"level3": {"parsed_answer": "x"}}}', "y"), ("nonsense", None), (None, None)])
def test_first_present_name_wins(spark, record, wanted):
    assert one(spark, E.present_field(F.lit(record).cast("string"), ("a", "b", "answer"))) == wanted


@pytest.mark.parametrize(("said", "wanted"), [("N012-N034", (12, 34)), (" N0012 ", (12, 12)), ("N034-N012", None), ("N1", None), ("N012 to N034", None), (None, None)])
def test_note_range(spark, said, wanted):
    got = one(spark, E.note_range(F.lit(said).cast("string")))
    assert (None if got is None else tuple(got)) == wanted


@pytest.mark.parametrize(("said", "wanted"), [("2.5", 2.5), ("100", 60.0), ("0", 1.0), ("-3", 1.0), ("soon", 1.0), ("true", 1.0), (None, 1.0)])
def test_clamped_wait(spark, said, wanted):
    assert one(spark, E.clamped_wait(F.lit(said).cast("string"))) == wanted


@pytest.mark.parametrize(("said", "wanted"), [('[{"start": 1, "end": "2.5"}, {"start": 3, "end": 1}]', [(1.0, 2.5)]), ("[[1, 2, 9], [4], [5, 4]]", [(1.0, 2.0)]), ("from 1 - 2 and 4 to 9", [(1.0, 2.0), (4.0, 9.0)]), ("[]", []), ("[oops", [])])
def test_interval_items(spark, said, wanted):
    assert [tuple(x) for x in one(spark, N.interval_items(F.lit(said)))] == wanted


@pytest.mark.parametrize(("out", "err", "wanted"), [('{"pass": true}', "Overall: FAIL", True), ('x\n{"pass": "yes"}', None, None), ("Overall: PASS", None, True), ("", "Overall: FAIL", False), ("overall: pass", "", None), (None, None, None)])
def test_grader_pass(spark, out, err, wanted):
    assert one(spark, E.grader_pass(F.lit(out).cast("string"), F.lit(err).cast("string"))) == wanted


@pytest.mark.parametrize("text", ['{"items": [{"filename": "f", "tags": ["a", "b"]}, {"filename": "g"}]}', '[{"filename": "f", "tags": ["a", "b"]}, {"filename": "g", "tags": null}]', '{"a": ["f"], "b": ["f"]}'])
def test_tag_index_shapes(spark, text):
    got = {r["filename"]: r["tags"] for r in one(spark, E.tag_index(F.lit(text)))}
    assert got["f"] == ["a", "b"] and got.get("g", []) == []
    assert one(spark, E.tag_index(F.lit("oops"))) == []


def test_claims(spark):
    c = lambda text, expected, **k: tuple(one(spark, E.claim_check(F.lit(text), r"took ([0-9.,]+)", F.lit(expected).cast("double"), **k)))[:2]
    assert c("it took 1,040 s", 1000.0) == (True, 1040.0) and c("it took 1100", 1000.0) == (False, 1100.0)
    assert c("it took 12", None) == (True, 12.0) and c("nothing", None) == (False, None) and c("took 12", 10.0, tolerance=2.0, absolute=True) == (True, 12.0)
    df = spark.createDataFrame([("a", True, 1.0, 5.0), ("a", False, 3.0, None), ("b", False, 1.0, 2.0)], "k string, ok boolean, w double, e double")
    assert {r["k"]: (r["score"], r["ok"]) for r in E.claims_score(df, "k", "ok", "w", "e").collect()} == {"a": (0.25, True), "b": (0.0, False)}


def test_similar_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(k, rng.choice("xy"), [rng.choice("abcdefghij") for _ in range(rng.randrange(9))]) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, g string, w array<string>")
    for least in (0.3, 0.5, 0.75, 1.0):
        got = {(r["a"], r["b"]): r["jaccard"] for r in E.similar_pairs(df, "id", "w", least, "g").collect()}
        sets = {k: (g, set(w)) for k, g, w in rows}
        want = {(a, b): len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and sets[a][1] and sets[b][1]}
        assert got == pytest.approx({p: j for p, j in want.items() if j >= least})
    assert E.similar_pairs(df.limit(0), "id", "w", 0.5).count() == 0


def test_tool_summary_counts_syntax_failures(spark):
    calls = spark.createDataFrame([("a", "execute_commands", "python x.py", False), ("a", "browser", "curl http://x", False), ("a", None, "", False), ("a", "execute_commands", "cat /etc/passwd", True), ("b", "execute_commands", "cat /work/../etc/x", False)], "k string, name string, command string, malformed boolean")
    replies = spark.createDataFrame([("a", "tool", "bash: SYNTAX error? no\nSyntaxError: invalid syntax"), ("a", "assistant", "SyntaxError"), ("a", "tool", "fine"), ("c", "tool", "Unexpected EOF while parsing"), ("c", "tool", None)], "k string, role string, text string")
    got = {r["k"]: tuple(r)[1:7] for r in W.tool_summary(calls, replies, "k", "/work").collect()}
    assert got == {"a": (4, 2, 2, 0, 1, 1.0), "b": (1, 0, 0, 1, 0, 0.5), "c": (0, 0, 0, 0, 1, 1.0)}


def test_reward_components(spark):
    runs = spark.createDataFrame([("a", "Cat.", "task_complete", ["cat."], ["v.mp4"], None, 5), ("b", None, "timeout", ["cat"], None, None, 0), ("c", "dog", "task_complete", ["cat"], ["v"], ["v"], 0)], "k string, prediction string, exit_reason string, truths array<string>, videos array<string>, audios array<string>, seen int")
    calls = spark.createDataFrame([("a", "execute_commands", "FFmpeg -i v", False), ("c", "execute_commands", "ls", False)], "k string, name string, command string, malformed boolean")
    none = spark.createDataFrame([], "k string, role string, text string")
    got = {r["k"]: r for r in W.rewarded(runs, W.tool_summary(calls, none, "k", "/w"), "k", ("ffmpeg",), ("sox",), (), observed="seen").collect()}
    assert (got["a"]["score"], got["a"]["n_tool"], got["a"]["correctness"]) == (1.0, 5, 1.0)
    assert (got["b"]["score"], got["b"]["removed"], got["b"]["n_tool"]) == (0.0, True, 0)
    assert got["c"]["score"] == pytest.approx(0.2 - 0.3) and got["c"]["has_video"] and not got["c"]["has_audio"]


def test_group_reason_is_rounded(spark):
    df = spark.createDataFrame([("a", 0.12345, False)] * 2 + [("b", 1.0, False), ("c", 0.1, True), ("c", 0.2, False), ("d", 0.1, False), ("d", 0.9, False)], "g string, reward double, removed boolean")
    assert {r["g"]: (r["keep"], r["reason"]) for r in W.group_filter(df, "g").collect()} == {"a": (False, "zero_std_0.123"), "b": (False, "active_1"), "c": (False, "removed_1"), "d": (True, None)}


def test_conversion(spark):
    rows = [("k", 0, "system", "be good"), ("k", 1, "user", "what?"), ("k", 2, "assistant", "first try"), ("k", 3, "user", "please CALL A TOOL"), ("k", 4, "assistant", "it is <answer>5</answer>"), ("k", 5, "tool_call", '{"name": "image_read", "arguments": {}}'), ("k", 6, "tool_response", "read "), ("k", 7, "user", "<image>"), ("k", 8, "assistant", ""), ("k", 9, "assistant", "so <answer>7</answer>"),
            ("j", 0, "user", "hm"), ("j", 1, "assistant", "<answer>1</answer>"), ("j", 2, "tool_call", '{"name": "task_complete", "arguments": {}}'), ("j", 3, "tool_response", "")]
    got = {r["k"]: [(m["role"], m["text"]) for m in r["messages"]] for r in P.converted(spark.createDataFrame(rows, "k string, place int, role string, text string"), "k", "place", "role", "text", reminder="CALL A TOOL").collect()}
    assert [r for r, _ in got["k"]] == ["system", "user", "assistant", "tool_call", "tool_response", "assistant", "tool_call", "tool_response"]
    assert got["k"][2][1] == "it is <answer>5</answer>" and got["k"][4][1] == "read <image>" and got["k"][5][1] == "so <answer>7</answer>"
    assert [r for r, _ in got["j"]] == ["user", "assistant", "tool_call", "tool_response"]


def test_set_digest_has_no_order(spark):
    d = lambda df: df.agg(P.set_digest(F.col("id"))).first()[0]
    assert d(spark.range(100)) == d(spark.range(100).orderBy(F.desc("id")).repartition(7)) != d(spark.range(99))


def test_session_tokens(spark):
    use = lambda i, o: '{"input_tokens": %d, "cache_creation_input_tokens": 1, "output_tokens": %d}' % (i, o)
    turn = lambda i, o: '{"type": "assistant", "message": {"usage": %s}}' % use(i, o)
    rows = [("a", 0, turn(1, 2)), ("a", 1, '{"type": "result", "usage": %s}' % use(9, 9)), ("a", 2, '{"type": "result"}'), ("b", 0, turn(5, 6)), ("b", 1, '{"type": "result", "usage": %s}' % use(3, 4)), ("b", 2, turn(1, 1)), ("c", 0, '{"type": "user"}'), ("d", 0, "oops")]
    got = {r["k"]: (r["prompt_tokens"], r["completion_tokens"]) for r in E.session_tokens(spark.createDataFrame(rows, "k string, place int, event string"), "k", "place", "event").collect()}
    assert got == {"a": (2, 2), "b": (4, 4), "c": (0, 0), "d": (0, 0)}


def test_calls_without_an_id_count_by_themselves(spark):
    rows = [("a", x) for x in ('{"type": "item.started", "item": {"type": "command_execution", "id": "1"}}', '{"type": "exec_command_begin", "call_id": "1"}', '{"type": "web_search"}', '{"type": "web_search", "call_id": ""}', '{"type": "item.completed", "item": {"id": "9"}}', "oops")]
    assert E.distinct_calls(spark.createDataFrame(rows, "k string, event string"), "k", "event").first()["calls"] == 3


@pytest.mark.parametrize("least", [0.5, 0.6, 0.85, 1.0])
def test_similar_pairs_meet_by_choices_of_rare_words(spark, least):
    """Few words, so single ones say little; many equal sets, of which one is compared."""
    rng = random.Random(4)
    rows = [(g, k, [rng.choice("abcdefgh") for _ in range(rng.randrange(8))] + ["same"] * (k % 2)) for g in range(2) for k in range(120)]
    rows += [(2, k, [f"w{x}" for x in rng.sample(range(40), 30)]) for k in range(60)]
    want = {}
    for (g, a, x), (h, b, y) in itertools.permutations(rows, 2):
        if g == h and a < b and x and y and (j := len({*x} & {*y}) / len({*x} | {*y})) >= least:
            want[g, a, b] = j
    df = spark.createDataFrame(rows, "g int, k int, w array<string>")
    got = E.similar_pairs(df, "k", "w", least, "g").collect()
    assert {(r["g"], r["a"], r["b"]): r["jaccard"] for r in got} == want and len(got) == len(want)
    sets = df.select("g", "k", F.array_sort(F.array_distinct("w")).alias("w")).filter(F.size("w") > 0).groupBy("g", "w").agg(F.min("k").alias("x"))
    assert E._near_sets(sets, least, ["g"]).count() < max(1, len(want))  # equal sets are not among these
