"""Queries of decoders, names of files, numbers, normalizers and rules over the values of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import nested as N
from millrace.functions import text as X
from millrace.operators import records as E
from millrace.operators import reward as W
from millrace.plans.base import query, table
from millrace.sources import scan


def _quoted(c):
    """A text as a JSON string."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


@query("command_forms", r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g') AS w FROM conversations),
f AS (SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN [x, 'pwd'] WHEN 1 THEN [x] WHEN 2 THEN [x] WHEN 3 THEN [x, w || '!'] WHEN 4 THEN [w || chr(10)] WHEN 5 THEN [x] ELSE [] END AS f FROM c)
SELECT conv_id, turn, len(f) AS n, md5(array_to_string(f, '|')) AS h FROM f""")
def _(spark, d):
    """Turns as arguments of a tool: an object with a list, with one text, with keystrokes, a list, a text with a bare line end, a text of its own, and no JSON."""
    c, k = table(spark, d, "conversations"), (F.col("conv_id") + F.col("turn")) % 7
    text = F.coalesce("text", F.lit(""))
    x, plain = _quoted(text), F.regexp_replace(text, "[^A-Za-z ]", "")
    said = (
        F.when(k == 0, F.concat(F.lit('{"commands": [{"keystrokes": '), x, F.lit(', "wait": 2}, "pwd"]}'))).when(k == 1, F.concat(F.lit('{"keystrokes": "no", "commands": '), x, F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"keystrokes": '), x, F.lit("}"))).when(k == 3, F.concat(F.lit("["), x, F.lit(', {"keystrokes": "'), plain, F.lit('!"}, {"other": 1}, 3, {"keystrokes": null}]')))
        .when(k == 4, F.concat(F.lit('{"commands": "'), plain, F.lit('\n"}\n'))).when(k == 5, x).otherwise(F.concat(F.lit("run "), x))
    )
    found = c.select("conv_id", "turn", N.commands(said).alias("f"))
    return found.select("conv_id", "turn", F.size("f").cast("long").alias("n"), F.md5(F.array_join("f", "|").cast("binary")).alias("h"))


@query("argument_maps", "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 0 THEN 3 ELSE 0 END::BIGINT AS n, CASE WHEN (conv_id + turn) % 4 = 0 THEN text END AS said, CASE WHEN (conv_id + turn) % 4 = 0 THEN '[' || turn || ',2]' END AS at FROM conversations")
def _(spark, d):
    """Arguments as an object, none, a list, and no JSON."""
    k = (F.col("conv_id") + F.col("turn")) % 4
    given = F.when(k == 0, F.concat(F.lit('{"say": '), _quoted("text"), F.lit(', "at": ['), "turn", F.lit(', 2], "deep": {"a": null}}'))).when(k == 1, "").when(k == 2, F.concat(F.lit("["), _quoted("text"), F.lit("]"))).otherwise("text")
    m = table(spark, d, "conversations").select("conv_id", "turn", N.argument_map(given).alias("m"))
    return m.select("conv_id", "turn", F.size("m").cast("long").alias("n"), F.col("m")["say"].alias("said"), F.col("m")["at"].alias("at"))


@query("numbers_of_texts", """SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN l_extendedprice WHEN 1 THEN -l_extendedprice WHEN 2 THEN l_partkey / 1000.0::DOUBLE WHEN 3 THEN 1000.0 * l_suppkey + 500 END::DOUBLE AS number FROM lineitem""")
def _(spark, d):
    """Prices and keys as plain, signed, in powers of ten, with underscores, and with a unit, a suffix, or a comma."""
    k, price = (F.col("l_orderkey") + F.col("l_linenumber")) % 7, F.col("l_extendedprice").cast("double").cast("string")
    said = (
        F.when(k == 0, F.concat(F.lit(" "), price, F.lit("\n"))).when(k == 1, F.concat(F.lit("-"), price)).when(k == 2, F.concat("l_partkey", F.lit("E-3"))).when(k == 3, F.concat("l_suppkey", F.lit("_500")))
        .when(k == 4, F.concat("l_partkey", F.lit("d"))).when(k == 5, F.concat("l_suppkey", F.lit(" %"))).otherwise(F.concat("l_partkey", F.lit(",5")))
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.as_number(said).alias("number"))


@query("file_resolution", """WITH p AS (SELECT p_size, p_partkey % 5 AS k, p_size % 4 AS e, replace(p_name, ' ', '-') || '_' || p_partkey AS stem, ['.txt', '.md', '.csv', '.bin'][p_size % 4 + 1] AS ext FROM part)
SELECT p_size AS folder, CASE k WHEN 0 THEN stem || ext WHEN 1 THEN upper(replace(stem, '-', '_') || ext) WHEN 2 THEN lower(stem) || '.json' WHEN 3 THEN replace(stem, '-', '.') || '.bin' ELSE 'other' || stem || ext END AS wanted,
CASE WHEN k < 2 OR (k = 2 AND e < 3) OR (k = 3 AND e = 3) THEN stem || ext END AS name FROM p""")
def _(spark, d):
    """A file of each part in the folder of its size, and a name for it that is exact, written otherwise, or of another kind."""
    ext = F.get(F.array(*map(F.lit, (".txt", ".md", ".csv", ".bin"))), (F.col("p_size") % 4).cast("int"))
    p = table(spark, d, "part").select(F.col("p_size").alias("folder"), (F.col("p_partkey") % 5).alias("k"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), F.col("p_partkey")).alias("stem"), ext.alias("ext"))
    k, name = F.col("k"), F.concat("stem", "ext")
    said = (
        F.when(k == 0, name).when(k == 1, F.upper(F.concat(F.replace("stem", F.lit("-"), F.lit("_")), "ext"))).when(k == 2, F.concat(F.lower("stem"), F.lit(".json")))
        .when(k == 3, F.concat(F.replace("stem", F.lit("-"), F.lit(".")), F.lit(".bin"))).otherwise(F.concat(F.lit("other"), name))
    )
    return scan.resolved(p.select("folder", said.alias("wanted")), p.select("folder", name.alias("name")), ["folder"])


_RULED = """t AS (SELECT o_custkey AS g, o_orderkey AS id, CAST(o_orderkey % 5 AS DOUBLE) / 4 AS reward, o_orderkey % 13 = 0 AS removed, CAST(o_totalprice AS DOUBLE) AS price FROM orders),
a AS (SELECT g, CASE WHEN count(*) FILTER (removed) > 0 THEN 'removed' WHEN count(*) FILTER (NOT removed) <= 1 THEN 'active' WHEN max(reward) - min(reward) <= 1e-8 THEN 'zero' WHEN count(*) > 12 THEN 'large' WHEN max(price) < 100000 THEN 'cheap' END AS why FROM t GROUP BY g)"""


def _ruled(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), k.alias("id"), ((k % 5).cast("double") / 4).alias("reward"), (k % 13 == 0).alias("removed"), F.col("o_totalprice").cast("double").alias("price"))
    return rows, [*W.group_rules(), (F.count("*") > 12, F.lit("large_")), (F.max("price") < 100_000, F.lit("cheap_"))]


@query("group_rules", f"WITH {_RULED} SELECT g, why IS NULL AS keep, why FROM a")
def _(spark, d):
    """The usual rules and two of one's own."""
    rows, rules = _ruled(spark, d)
    return W.group_filter(rows, "g", rules=rules).select("g", "keep", F.substring_index("reason", "_", 1).alias("why"))


@query("rewards_after_rules", f"WITH {_RULED} SELECT t.g, t.id, t.reward / max(t.reward) OVER (PARTITION BY t.g) AS share FROM t JOIN a ON a.g = t.g AND a.why IS NULL")
def _(spark, d):
    """Another hook than the usual one: rewards over the most of their group."""
    rows, rules = _ruled(spark, d)

    def shares(df, group):
        most = df.groupBy(group).agg(F.max("reward").alias("most"))
        return df.join(most, group).withColumn("share", F.col("reward") / F.col("most"))

    return W.trained_on(rows, "g", rules, shares).select("g", "id", "share")


@query("result_layouts", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS b, o_custkey, o_orderpriority AS said, o_orderstatus AS s, 'v/' || o_custkey AS clip FROM orders)
SELECT k AS source_index, b AS bench, said AS prediction, CASE b WHEN 0 THEN CAST(o_custkey AS VARCHAR) END AS id, CASE WHEN b > 0 THEN CAST(o_custkey AS VARCHAR) END AS question_id,
CASE b WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s END AS answer, CASE WHEN b = 2 THEN upper(s) END AS correct_option, CASE WHEN b > 2 THEN upper(s) END AS correct_answer, CASE b WHEN 3 THEN 'hard' WHEN 4 THEN 'easy' END AS level, CASE b WHEN 3 THEN clip END AS video_path, CASE b WHEN 4 THEN clip END AS video_file FROM o""")
def _(spark, d):
    """All five layouts of result rows, as one table."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    null = F.lit(None).cast("string")
    runs = o.select(k.alias("source_index"), F.col("o_orderpriority").alias("prediction"), (k % 2 == 0).alias("is_correct"), F.col("o_orderpriority").alias("raw_model_output"), F.lit(1).alias("tool_call_num"), F.lit(0).alias("return_code"), F.lit(False).alias("timed_out"), null.alias("stdout_text"), null.alias("stderr_text"))
    owner, status = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    letter, clip = F.concat(F.lit(" "), F.lower(status)), F.concat(F.lit("v/"), owner)
    items = o.select(k.alias("source_index"), owner.alias("id"), owner.alias("question_id"), status.alias("answer"), letter.alias("correct_option"), letter.alias("correct_answer"), clip.alias("video_path"), clip.alias("video_file"))
    names = ("open_answer", "exact_answer", "option_text", "option_letter", "yes_no")
    part = lambda b: runs.filter(F.col("source_index") % 5 == b)
    rows = [E.result_rows(part(b), items, name, f"{name}_prediction", gold=True, level={3: "hard", 4: "easy"}.get(b)).withColumn("bench", F.lit(b).cast("long")) for b, name in enumerate(names)]
    out = E.union_rows(rows, [f"{name}_prediction" for name in names])
    return out.select("source_index", "bench", "prediction", "id", "question_id", "answer", "correct_option", "correct_answer", "level", "video_path", "video_file")


@query("norm_exact_texts", r"""WITH s AS (SELECT p_partkey, p_partkey % 4 AS k, p_type, p_name, p_size, p_name || ' (' || p_brand || ')' AS t FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN lower(p_type) || ' 1 fi' ELSE p_partkey || ' of ' || p_size END AS n FROM s""")
def _(spark, d):
    """Words with punctuation, numbers in wide digits, compatibility characters, and numbers inside a text."""
    k = F.col("p_partkey") % 4
    wide = F.translate(F.col("p_partkey").cast("string"), "0123456789", "０１２３４５６７８９")
    said = F.when(k == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).when(k == 1, wide).when(k == 2, F.concat("p_type", F.lit(" － ① ﬁ."))).otherwise(F.concat("p_partkey", F.lit(", of: "), "p_size", F.lit("!")))
    return table(spark, d, "part").select("p_partkey", X.norm_exact(said).alias("n"))


@query("norm_predictions", r"SELECT conv_id, turn, md5(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS h FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(X.norm_pred(F.concat(F.lit(" \t"), F.coalesce("text", F.lit("")), F.lit("\n"))).cast("binary")).alias("h"))


@query("said_choices", """WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, chr(CAST(65 + o_custkey % 4 AS INTEGER)) AS letter FROM orders)
SELECT o_orderkey, CASE WHEN k < 5 THEN letter ELSE '' END AS choice FROM o""")
def _(spark, d):
    """A letter of each customer in the forms that are read, beside what the order's priority says."""
    k, letter = F.col("o_orderkey") % 6, F.chr(F.lit(65) + F.col("o_custkey") % 4)
    said = (
        F.when(k == 0, F.concat("o_orderpriority", F.lit("\nThe answer is: "), letter, F.lit("."))).when(k == 1, F.concat("o_custkey", F.lit(" thinks\n**"), letter, F.lit("**")))
        .when(k == 2, F.concat("o_orderpriority", F.lit(" <answer>("), letter, F.lit(")</answer>"))).when(k == 3, letter).when(k == 4, F.concat(F.lit("<answer> "), F.lower(letter), F.lit(" </answer>"))).otherwise(F.concat(F.lower("o_orderpriority"), F.lit(" by "), "o_custkey"))
    )
    return table(spark, d, "orders").select("o_orderkey", X.choice(said, "ABCD").alias("choice"))
