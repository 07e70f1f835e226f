import pytest
from pyspark.sql import functions as F

from millrace.functions import geometry as G
from millrace.functions import nested as N
from millrace.functions import text as X
from millrace.functions.nested import close_truncated


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (X.norm_filter, "  It's,  OK! ", "its ok"),
        (X.norm_reward, "Atlanta, Georgia and  Rome;Paris", "atlanta georgia rome paris"),
        (X.norm_exact, "8.0", "8"),
        (X.norm_exact, "1,234.50", "1234.5"),
        (X.norm_exact, "Front-Right!", "front right"),
        (X.norm_ident, " Clip ID-2 (s)", "clip_id_2_s"),
        (X.norm_label, "left turn-A", "left_turn_a"),
        (X.norm_asr, "Straße, ＯＫ", "strasse ok"),
        (X.last_real_answer, "<answer>7</answer> <answer>...</answer>", "7"),
        (X.last_real_answer, "<answer>...</answer>", "..."),
        (X.last_real_answer, "none", ""),
        (X.lenient_answer, "So\nFinal Answer: **42**\n", "42"),
        (X.lenient_answer, "the answer is unknown", ""),
        (X.lenient_answer, "Final answer: probably left", ""),
        (X.lenient_answer, "Final answer: yes", ""),
        (X.lenient_answer, "First, the answer = 12\nand so on", "12"),
        (X.lenient_answer, "an unanswer is nothing", ""),
        (X.norm_exact, "\uff18", "8"),
        (X.norm_exact, " \uff21\uff22!c ", "ab c"),
        (X.lenient_answer, "<answer>3</answer> Final Answer: 9", "3"),
        (X.yes_no, "Yes, it is", "A"),
        (X.yes_no, "No, it is not", "B"),
        (X.yes_no, "Need more analysis.", ""),
        (X.url_origin, "HTTPS://Example.org:443/a?b", "https://example.org"),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, f(F.lit(given))) == wanted


@pytest.mark.parametrize(
    ("said", "wanted"),
    [("Found it. <answer>C</answer>", "C"), ("Therefore the answer is: B.", "B"), ("- **D**", "D"), ("It could be anything", ""), ("I'd go with (A)", "A")],
)
def test_choice(spark, said, wanted):
    assert one(spark, X.choice(F.lit(said), "ABCD")) == wanted


@pytest.mark.parametrize(("said", "wanted"), [("<answer>x</answer><answer>(d)</answer>", "D"), ("A. apple\nB. pear", ""), ("see Disp.A | Volatile", ""), ("opt/A then C", "C"), ("the plum", "C"), ("", ""),
    ("I choose D, because A is too short.", "D"), ("I will pick C rather than A", "C"), ("The answer = B, not C", "B"), ("Our answer a week ago was wrong; the sound is D.", "D"), ("Each choice a person makes counts. It is D", "D"), ("I SELECT (b)", "B"), ("option A, correct option is *C*", "C"), ("  b) pear\nD", "D"), ("an A-Class car", "")])
def test_option_choice(spark, said, wanted):
    options = F.array(*map(F.lit, ("A. apple", "B. pear", "C. plum")))
    assert one(spark, X.option_choice(F.lit(said), options)) == wanted


def test_correctness_reasons(spark):
    c = lambda kind, p, t: tuple(one(spark, X.correctness(F.lit(kind), F.lit(p), F.array(*map(F.lit, t)) if t else F.lit(None).cast("array<string>"))))
    assert c("mcq", "A", ["a dog"]) == (True, "first_token_match")
    assert c("mcq", "cat", ["dog"]) == (False, "no_match_mcq")
    assert c("open", "a big dog", ["Dog"]) == (True, "open_substring(g_in_p=True)")
    assert c("open", "do", ["Dog"]) == (True, "open_substring(g_in_p=False)")
    assert c("open", "", ["Dog"]) == (False, "empty_prediction")
    assert c("open", "!!", ["Dog"]) == (False, "prediction_empty_after_normalize")
    assert c("open", "x", []) == (False, "no_ground_truth")


def test_times_numbers_tags(spark):
    assert one(spark, X.clock_seconds(F.lit("01:02:03,5"))) == 3723.5
    assert one(spark, X.clock_seconds(F.lit("soon"))) is None
    assert one(spark, X.tag_list(F.lit('["a", "b"]'))) == ["a", "b"]
    assert one(spark, X.tag_list(F.lit("a; b,c ;"))) == ["a", "b,c"]
    assert one(spark, X.first_difference(F.lit("abc"), F.lit("abd"))) == 2
    assert one(spark, X.first_difference(F.lit("ab"), F.lit("abc"))) == 2
    assert one(spark, X.word_error_rate(F.lit("a b c d"), F.lit("a x c"))) == 0.5
    assert one(spark, X.character_error_rate(F.lit(""), F.lit("x"))) == 1.0


@pytest.mark.parametrize(("cut", "whole"), [('{"a": [1, 2', '{"a": [1, 2]}'), ('{"a": "x', '{"a": "x"}'), ('{"a":', '{"a": null}'), ('{"a": 1,', '{"a": 1}'), ('{"a": "x\\', '{"a": "x"}'), ("{oops", None)])
def test_truncated_json(cut, whole):
    assert close_truncated(cut) == whole


def test_nested(spark):
    assert one(spark, N.closed(F.lit('{"a": {"b": "c')) ) == '{"a": {"b": "c"}}'
    assert tuple(one(spark, N.arguments(F.lit("[1]")))) == ("[1]", True) or one(spark, N.arguments(F.lit("[1]")))["malformed"]
    assert one(spark, N.arguments(F.lit(" ")))["value"] == "{}"
    assert [tuple(x) for x in one(spark, N.interval_pairs(F.lit("from 1.5-3, 9 to 4, [5, 6]")))][0] == (1.5, 3.0)
    assert one(spark, N.leaves(F.lit('{"a": ["x", {"b": "y"}], "c": 3}'))) == ["x", "y"]
    assert one(spark, N.commands(F.lit('{"commands": [{"keystrokes": "ls"}, "pwd"]}'))) == ["ls", "pwd"]
    assert one(spark, N.overall_verdict(F.lit("Overall: FAIL"))) is False
    assert one(spark, N.embedded_object(F.lit('noise {"score": 0.8} end'))) == '{"score": 0.8}'
    assert one(spark, N.boxes_by_time(F.lit("[{'time': 1, 'bbox': [[1,2,3,4],[5,6,7,8]]}]")))[1]["box"] == [5.0, 6.0, 7.0, 8.0]


def test_answers_are_stripped_as_python_does_or_as_sql_does(spark):
    said = F.lit("<answer> \u00a0Le\u00e9. \n</answer>")
    assert one(spark, X.last_answer(said)) == "\u00a0Le\u00e9."
    assert one(spark, X.last_answer(said, X.SPACES)) == "Le\u00e9. \n"


def test_queries_of_answers_keep_line_ends_as_their_sql_does(spark, tmp_path):
    from millrace.plans.catalog import ORACLE, QUERIES

    duckdb = pytest.importorskip("duckdb")
    rows = [(1, k, "user", t) for k, t in enumerate(["Le\u00e9.\nx", " Ita.\n more", "\u00a0 As\u00ed.\n\n", "\tab ", "Pa\u00ea \n", "\n\n\n\n\n", ""])]
    rows += [(2, k + 1, r, t) for _, k, r, t in rows]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("last_answer", "tag_or_text"):
        assert sorted(map(str, map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))) == sorted(map(str, duckdb.sql(ORACLE[name]).fetchall()))
    assert one(spark, X.tag_or_text(F.lit(" \tB\n"))) == "B"


def test_asr_form_looks_each_character_up_once(monkeypatch):
    import unicodedata

    def plain(text):
        t = unicodedata.normalize("NFKC", text).casefold()
        dense = any(k in unicodedata.name(x, "") for x in t for k in ("CJK", "HIRAGANA", "KATAKANA"))
        shown = "".join(("" if dense else " ") if unicodedata.category(x)[0] in "PS" else x for x in t)
        return ("" if dense else " ").join(shown.split())

    said = ["", "Stra\u00dfe, \uff2f\uff2b!\n", "\u4f60\u597d, \u4e16\u754c.", "\u3053\u3093 \u30ab\u30ca\u3002", *("".join(map(chr, range(k, k + 500))) for k in range(0, 0xD000, 500))]
    assert [X.asr_form(t) for t in said] == [plain(t) for t in said]
    calls, look = [], unicodedata.category
    monkeypatch.setattr(X.unicodedata, "category", lambda x: calls.append(x) or look(x))
    X.asr_form("a\u00e9!" * 1000)
    assert len(calls) <= 3


def test_union_of_boxes_computes_its_boxes_a_few_times_only(spark):
    made = F.array(G.unit_box(F.array(F.col("size"), F.lit(0.1), F.lit(0.5), F.lit(0.6))))
    df = spark.createDataFrame([(0.1,), (None,)], "size double").select(G.union_iou(F.array(F.array(*map(F.lit, (0.1, 0.1, 0.5, 0.6)))), F.filter(made, lambda x: x.isNotNull())).alias("v"))
    assert df._jdf.queryExecution().analyzed().toString().count("size#") < 10
    assert [r["v"] for r in df.collect()] == [pytest.approx(1.0), 0.0]


def test_geometry(spark):
    box = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, G.box_iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, G.unit_box(box(900, 100, 100, 500))) == pytest.approx([0.1, 0.1, 0.9, 0.5])
    assert one(spark, G.unit_box(box(0.5, 0.5, 0.5, 0.9))) is None
    assert one(spark, G.union_area(F.array(box(0, 0, 2, 2), box(1, 1, 3, 3), box(0, 0, 1, 1)))) == pytest.approx(7.0)
    assert one(spark, G.union_iou(F.array(box(0, 0, 1, 1)), F.array().cast("array<array<double>>"))) == 0.0
    assert one(spark, G.contained(box(0, 0, 2, 2), box(1, 0, 5, 5))) == pytest.approx(0.5)
    assert one(spark, G.iou_inclusive(F.lit(1), F.lit(4), F.lit(4), F.lit(8))) == pytest.approx(1 / 8)
    assert one(spark, G.iou_enclosing(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == 0.0
    assert one(spark, G.angle_between(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0))) == pytest.approx(90.0)
    assert one(spark, G.credit(F.lit(2.0), F.lit(4.0), F.lit(True))) == 0.5


def test_wer_and_bleu_read_whole_texts(spark, tmp_path):
    from millrace.plans.catalog import QUERIES

    words = [f"w{k:05d}" for k in range(1000)]
    spark.createDataFrame([(1, 0, " ".join(words))], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["wer"](spark, str(tmp_path)).first()["wer"] == pytest.approx(1 / 1000)
    assert QUERIES["corpus_bleu"](spark, str(tmp_path)).first()["bleu"] == pytest.approx(2.718281828459045 ** (-1 / 999))


def test_commands_of_all_forms(spark):
    import json

    given = {
        '{"commands": [{"keystrokes": "ls"}, "pwd", {"x": 1}, 3, null, {"keystrokes": null}]}': ["ls", "pwd"],
        '{"commands": "ls\\n"}': ["ls\n"], '{"commands": "a\tb\nc"}': ["a\tb\nc"], '{"commands": null, "keystrokes": "x"}': [],
        '{"keystrokes": "x", "wait": 1}': ["x"], '["a", {"keystrokes": "b"}]': ["a", "b"], '"a"': ["a"], "3": [], "null": [], "{}": [], "": [], "ls": [], '{"commands": [': [],
        json.dumps({"commands": [{"keystrokes": 'say "hé" \u2028'}]}): ['say "hé" \u2028'], '{"commands": []}': [], '{"commands": {"keystrokes": "x"}}': ["x"],
    }
    df = spark.createDataFrame([(t, f) for t, f in given.items()] + [(None, None)], "t string, f array<string>")
    for r in df.select("t", "f", N.commands(F.col("t")).alias("got")).collect():
        assert r["got"] == r["f"], r["t"]


def test_argument_maps(spark):
    rows = [('{"a": "x", "b": [1, {"c": 2}], "d": null}', {"a": "x", "b": '[1,{"c":2}]', "d": None}), ("", {}), ("[1]", {}), ("no", {}), ('"x"', {}), (None, {})]
    for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", N.argument_map(F.col("t")).alias("m")).collect():
        assert r["m"] == dict(rows)[r["t"]], r["t"]


def test_numbers_are_those_that_python_reads(spark):
    texts = ["1", " -2.5\n", "+3.", ".5", "1e3", "1E-2", "1_000", "1__0", "_1", "1_", "1d", "2f", "0x10", "inf", "-Infinity", "NaN", "nanx", "", " ", ".", "e5", "1e", "1,5", "12 %", "--1", "1_0.2_5e1_0"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.as_number(F.col("t")).alias("v")).collect():
        try:
            want = float(r["t"])
        except ValueError:
            want = None
        assert repr(r["v"]) == repr(want), r["t"]
