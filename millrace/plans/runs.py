"""Queries for records of runs: fields, result rows, tool use, rewards, claims, and the joins of graders."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import nested as N
from millrace.functions import text as X
from millrace.operators import records as E
from millrace.operators import reward as W
from millrace.plans import flows as P
from millrace.plans.base import EV, events, query, table


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


_KIND = "o_orderkey % 6"


@query("canonical_field", f"SELECT o_orderkey, CASE {_KIND} WHEN 0 THEN o_orderpriority WHEN 1 THEN NULL WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN o_orderstatus END AS answer, {_KIND} < 4 AS has FROM orders")
def _(spark, d):
    """0: by name; 1: the first name is there but null, so the second does not count; 2: nested; 3: the second name; 4, 5: none."""
    k, q = F.col("o_orderkey") % 6, lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    record = (
        F.when(k == 0, F.concat(F.lit('{"x": 1, "level3_answer": '), q(F.col("o_orderpriority")), F.lit(', "answer": "no"}')))
        .when(k == 1, F.concat(F.lit('{"level3_answer": null, "answer": '), q(F.col("o_orderpriority")), F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"runs": {"level3": {"parsed_answer": '), F.col("o_custkey"), F.lit("}}}")))
        .when(k == 3, F.concat(F.lit('{"answer": '), q(F.col("o_orderstatus")), F.lit(', "runs": {"level3": {"parsed_answer": "no"}}}')))
        .when(k == 4, F.lit('{"runs": {"level4": {"parsed_answer": "no"}}}'))
        .otherwise(F.lit('{"runs": [1]}'))
    )
    names = ("level3_answer", "answer")
    return _orders(spark, d).select("o_orderkey", E.present_field(record, names).alias("answer"), E.has_field(record, names).alias("has"))


@query("result_rows", """WITH a AS (SELECT o_orderkey AS source_index, CAST(o_custkey AS VARCHAR) AS question_id, o_orderstatus AS difficulty, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS prediction, upper(trim(o_orderstatus)) AS correct_option FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT o_orderkey AS source_index, CAST(o_custkey AS VARCHAR) AS question_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS prediction FROM orders WHERE o_orderkey % 2 = 1)
SELECT source_index, question_id, difficulty, prediction, prediction AS predicted_option, NULL AS level3_answer, correct_option, '' AS stderr_text FROM a UNION ALL SELECT source_index, question_id, NULL, prediction, NULL, prediction, NULL, '' FROM b""")
def _(spark, d):
    o = table(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("source_index"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("prediction"), F.lit(True).alias("is_correct"), F.lit("t").alias("raw_model_output"), F.lit(1).alias("tool_call_num"), F.lit(0).alias("return_code"), F.lit(False).alias("timed_out"), F.lit("x").alias("stdout_text"), F.lit(None).cast("string").alias("stderr_text"))
    items = o.select(F.col("o_orderkey").alias("source_index"), F.col("o_custkey").cast("string").alias("question_id"), F.col("o_orderstatus").alias("difficulty"), F.concat(F.lit(" "), F.lower("o_orderstatus")).alias("correct_option"))
    a = E.result_rows(runs.filter("source_index % 2 = 0"), items, "option_text", "predicted_option", gold=True)
    b = E.result_rows(runs.filter("source_index % 2 = 1"), items.drop("difficulty"), "exact_answer", "level3_answer")
    return E.union_rows([a, b], ["predicted_option", "level3_answer"]).select("source_index", "question_id", "difficulty", "prediction", "predicted_option", "level3_answer", "correct_option", "stderr_text")


@query("group_fan_out", "SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey % 4) < 3 THEN chr(CAST(65 + l_orderkey % 4 AS INTEGER)) ELSE '' END AS prediction, CASE WHEN (l_orderkey % 4) < 3 THEN l_orderkey % 4 = l_linenumber % 4 ELSE false END AS is_correct FROM lineitem")
def _(spark, d):
    """A run of an order answers all its lines."""
    from millrace.plans.specs import spec

    s = spec("option_letter")
    letter = lambda k: F.chr(F.lit(65) + k)
    said = F.when(F.col("o_orderkey") % 4 < 3, F.concat(F.lit("thinking\nThe answer is: "), letter(F.col("o_orderkey") % 4))).otherwise("nothing to say")
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), said.alias("raw_model_output"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(None).cast("array<string>").alias("options"), letter(F.col("l_linenumber") % 4).alias("truth"))
    return E.fanned_out(runs, items, "l_orderkey", s.extract, s.judge).select("l_orderkey", "l_linenumber", "prediction", "is_correct")


@query("content_block_count", "SELECT user_id, sum(CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE 0 END)::BIGINT AS tool_uses FROM events GROUP BY user_id")
def _(spark, d):
    """A third of the events are assistant messages with up to three calls among texts; another third has text content, the rest is of another type."""
    k = F.col("event_id")
    block = lambda kind: F.struct(F.lit(kind).alias("type"), F.lit("t").alias("text"))
    blocks = F.concat(F.array(block("text")), F.array_repeat(block("tool_use"), (k % 4).cast("int")))
    message = F.when(k % 3 == 1, F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.lit("tool_use").alias("content")).alias("message")))).otherwise(F.to_json(F.struct(F.when(k % 3 == 0, "assistant").otherwise("user").alias("type"), F.struct(blocks.alias("content")).alias("message"))))
    return E.tool_use_blocks(table(spark, d, "events").select("user_id", message.alias("event")), "user_id", "event")


_TOKENS = "t AS (SELECT user_id, event_id, event_type, event_id % 40 AS i, user_id % 7 AS c, event_id % 9 AS o, event_id % 3 AS k FROM events)"


@query("token_sums", f"""WITH {_TOKENS}, l AS (SELECT user_id, arg_max(CASE WHEN k = 0 THEN 0 ELSE i + c END, event_id) AS lp, arg_max(CASE WHEN k = 0 THEN 0 ELSE o END, event_id) AS lc FROM t WHERE event_type = 'purchase' GROUP BY 1),
s AS (SELECT user_id, coalesce(sum(i + c) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS p, coalesce(sum(o) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS q FROM t GROUP BY 1)
SELECT user_id, CASE WHEN coalesce(lp, 0) + coalesce(lc, 0) > 0 THEN lp ELSE p END::BIGINT AS prompt_tokens, CASE WHEN coalesce(lp, 0) + coalesce(lc, 0) > 0 THEN lc ELSE q END::BIGINT AS completion_tokens FROM s LEFT JOIN l USING (user_id)""")
def _(spark, d):
    """Purchases are result events, a third of them without usage; views are assistant messages; other events have usage that does not count."""
    k = F.col("event_id")
    usage = F.struct((k % 40).alias("input_tokens"), (F.col("user_id") % 7).alias("cache_read_input_tokens"), (k % 9).alias("output_tokens"))
    kind = F.when(F.col("event_type") == "purchase", "result").when(F.col("event_type") == "view", "assistant").otherwise("user")
    text = F.when(kind == "result", F.to_json(F.struct(kind.alias("type"), F.when(k % 3 != 0, usage).alias("usage")))).otherwise(F.to_json(F.struct(kind.alias("type"), F.struct(usage.alias("usage")).alias("message"))))
    return E.session_tokens(table(spark, d, "events").select("user_id", "event_id", text.alias("event")), "user_id", "event_id", "event")


@query("turn_token_sums", f"WITH {_TOKENS} SELECT user_id, coalesce(sum(i) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS input_tokens, coalesce(sum(o) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS output_tokens, coalesce(sum(c) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS cached_input_tokens, coalesce(sum(i + o) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS total_tokens FROM t GROUP BY user_id")
def _(spark, d):
    k = F.col("event_id")
    usage = F.struct((k % 40).alias("input_tokens"), (k % 9).alias("output_tokens"), (F.col("user_id") % 7).alias("cached_input_tokens"))
    text = F.to_json(F.struct(F.when(F.col("event_type") == "click", "turn.completed").otherwise("turn.started").alias("type"), usage.alias("usage")))
    return E.turn_tokens(table(spark, d, "events").select("user_id", text.alias("event")), "user_id", "event")


@query("distinct_tool_calls", "SELECT user_id, count(DISTINCT CASE WHEN event_type IN ('click', 'view') AND event_id % 4 > 0 THEN event_id % 25 END) + count(*) FILTER (WHERE event_type IN ('click', 'view') AND event_id % 4 = 0) AS calls FROM events GROUP BY user_id")
def _(spark, d):
    """Clicks are started commands, views are events of a tool's type; a quarter has no id, and ids repeat over both kinds."""
    k = F.col("event_id")
    ident = F.when(k % 4 > 0, F.concat(F.lit("c"), (k % 25).cast("string")))
    started = F.to_json(F.struct(F.lit("item.started").alias("type"), F.struct(F.lit("command_execution").alias("item_type"), ident.alias("id")).alias("item")))
    other = F.to_json(F.struct(F.lit("mcp_tool_call_begin").alias("type"), ident.alias("call_id")))
    text = F.when(F.col("event_type") == "click", started).when(F.col("event_type") == "view", other).otherwise(F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(ident.alias("id")).alias("item"))))
    return E.distinct_calls(table(spark, d, "events").select("user_id", text.alias("event")), "user_id", "event")


@query("glossary_coverage", "WITH f AS (SELECT DISTINCT p_type, trim(p_brand) AS p_brand FROM part WHERE p_size % 3 = 0), g AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size % 2 = 0) SELECT count(DISTINCT p_type) FILTER (WHERE (p_type, p_brand) IN (SELECT (p_type, p_brand) FROM f)) AS covered, count(*) AS total, count(DISTINCT p_type) FILTER (WHERE (p_type, p_brand) IN (SELECT (p_type, p_brand) FROM f)) / greatest(count(*), 1)::DOUBLE AS ratio FROM g")
def _(spark, d):
    p = table(spark, d, "part")
    found = p.filter("p_size % 3 = 0").select("p_type", F.concat(F.lit(" "), "p_brand").alias("p_brand"))
    return E.both_terms(found, p.filter("p_size % 2 = 0").select("p_type", "p_brand").distinct(), ["p_type", "p_brand"])


@query("match_then_lookup", """WITH m AS (SELECT a.l_orderkey * 10 + a.l_linenumber AS l, b.l_orderkey * 10 + b.l_linenumber AS r, least(a.l_quantity, b.l_quantity) / greatest(a.l_quantity, b.l_quantity) AS s FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 = 0 AND b.l_linenumber % 2 = 1),
w AS (SELECT l, r FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) AS n FROM m) WHERE n = 1 AND s >= 0.5), f AS (SELECT l_orderkey * 10 + l_linenumber AS r, l_returnflag AS rule, bool_or(l_tax > 0.03) AS bad FROM lineitem GROUP BY ALL)
SELECT w.l, k.rule, coalesce(f.bad, false) AS bad FROM w CROSS JOIN (SELECT DISTINCT rule FROM f) k LEFT JOIN f ON f.r = w.r AND f.rule = k.rule""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_tax")
    name = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    a = li.filter("l_linenumber % 2 = 0").select("l_orderkey", name.alias("l"), F.col("l_quantity").alias("x"))
    b = li.filter("l_linenumber % 2 = 1").select("l_orderkey", name.alias("r"), F.col("l_quantity").alias("y"))
    won = P.best_match(a.join(b, "l_orderkey").withColumn("s", F.least("x", "y") / F.greatest("x", "y")), "l", "s", "r", 0.5)
    flags = li.groupBy(name.alias("right"), F.col("l_returnflag").alias("rule")).agg(F.bool_or(F.col("l_tax") > 0.03).alias("bad"))
    return E.matched_lookup(won, flags, "l", "right", "bad")


@query("semi_overlap_iou", f"WITH {EV}, sp AS (SELECT event_id, user_id, event_type, sec AS s, sec + cents AS e FROM ev) SELECT event_id FROM sp a WHERE event_type IN ('click', 'view') AND event_id % 2 = 0 AND EXISTS (SELECT 1 FROM sp b WHERE b.event_id % 2 = 1 AND b.user_id = a.user_id AND b.event_type = a.event_type AND a.s < b.e AND b.s < a.e AND (least(a.e, b.e) - greatest(a.s, b.s))::DOUBLE / ((a.e - a.s) + (b.e - b.s) - (least(a.e, b.e) - greatest(a.s, b.s))) >= 0.4)")
def _(spark, d):
    s = events(spark, d).select("event_id", "user_id", "event_type", F.col("sec").alias("s"), (F.col("sec") + F.col("cents")).alias("e"))
    left = s.filter("event_type in ('click', 'view') and event_id % 2 = 0").withColumn("_id", F.col("event_id"))
    right = s.filter("event_id % 2 = 1").select("user_id", "event_type", F.col("s").alias("s2"), F.col("e").alias("e2"))
    return E.overlapping_enough(left, right, ["user_id", "event_type"], 0.4, 6 * 3600).select("event_id")


@query("similar_pairs", r"WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations) SELECT a.conv_id, a.turn AS a, b.turn AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE AS jaccard FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE >= 0.1")
def _(spark, d):
    """All pairs of turns of a conversation that are alike by their words."""
    w = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w"))
    return E.similar_pairs(w, "turn", "w", 0.1, "conv_id")


@query("similar_parts", "WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_size), ' ')) AS w FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE AS jaccard FROM w a JOIN w b ON a.p_partkey < b.p_partkey AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE >= 0.6")
def _(spark, d):
    """All pairs of the whole table."""
    p = table(spark, d, "part")
    return E.similar_pairs(p.select("p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.col("p_size").cast("string"))), " ").alias("w")), "p_partkey", "w", 0.6)


@query("claim_tolerance", "WITH c AS (SELECT o_orderkey, o_totalprice AS e, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN floor(o_totalprice) WHEN 2 THEN floor(o_totalprice * 2) END AS f FROM orders) SELECT o_orderkey, f AS found, coalesce(abs(f - e) / greatest(1e-9, abs(e)) <= 0.05, false) AS ok FROM c")
def _(spark, d):
    k, e = F.col("o_orderkey") % 4, F.col("o_totalprice")
    f = F.when(k == 0, e).when(k == 1, F.floor(e).cast("double")).when(k == 2, F.floor(e * 2).cast("double"))
    said = F.concat(F.lit("We paid about "), F.coalesce(F.format_number(f, 2), F.lit("a lot")), F.lit(" in all, for 3 things."))
    c = E.claim_check(said, r"(?i)paid about ([0-9][0-9,]*(?:\.[0-9]+)?)", e)
    return table(spark, d, "orders").select("o_orderkey", c["found"].alias("found"), c["ok"].alias("ok"))


@query("note_ranges", "SELECT p_partkey, CAST(p_partkey % 900 + 100 AS BIGINT) AS first, CAST(p_partkey % 900 + 100 + CASE WHEN p_partkey % 4 = 1 THEN p_size ELSE 0 END AS BIGINT) AS last FROM part WHERE p_partkey % 4 < 2")
def _(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey") % 900 + 100
    note = lambda c: F.concat(F.lit("N"), c)
    said = F.when(k == 0, F.concat(F.lit(" "), note(n))).when(k == 1, F.concat(note(n), F.lit("-"), note(n + F.col("p_size")))).when(k == 2, F.concat(note(n + 9), F.lit("-"), note(n))).otherwise(F.concat(note(n), F.lit(" to "), note(n + 1)))
    """Of the four forms two are ranges."""
    return table(spark, d, "part").select("p_partkey", E.note_range(said).alias("r")).filter("r is not null").select("p_partkey", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))


@query("clamped_waits", f"WITH {EV} SELECT event_id, CASE event_id % 5 WHEN 0 THEN least(60.0, cents / 100.0) WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 ELSE 60.0 END::DOUBLE AS seconds FROM ev WHERE cents > 0")
def _(spark, d):
    k, v = F.col("event_id") % 5, F.col("cents") / 100
    said = F.when(k == 0, v.cast("string")).when(k == 1, F.lit("soon")).when(k == 2, (-v).cast("string")).when(k == 4, (v + 61).cast("string"))
    return events(spark, d).filter("cents > 0").select("event_id", E.clamped_wait(said).alias("seconds"))


@query("tag_index", "SELECT p_partkey, p_name AS filename, [p_brand, p_type] AS tags FROM part")
def _(spark, d):
    """The same entry in three shapes."""
    k = F.col("p_partkey") % 3
    entry = F.array(F.struct(F.col("p_name").alias("filename"), F.array("p_brand", "p_type").alias("tags")))
    turned = F.to_json(F.map_from_arrays(F.array("p_brand", "p_type"), F.array(F.array("p_name"), F.array("p_name"))))
    text = F.when(k == 0, F.to_json(F.struct(entry.alias("items")))).when(k == 1, F.to_json(entry)).otherwise(turned)
    return table(spark, d, "part").select("p_partkey", F.explode(E.tag_index(text)).alias("x")).select("p_partkey", "x.*")


@query("interval_items", "SELECT o_orderkey, CAST(o_orderkey % 90 AS DOUBLE) AS s, CAST(o_orderkey % 90 + 5 AS DOUBLE) AS e FROM orders")
def _(spark, d):
    """One good interval each, as an object, a pair or text, beside one that runs backwards."""
    k, s = F.col("o_orderkey") % 3, F.col("o_orderkey") % 90
    e = s + 5
    objects = F.to_json(F.array(F.struct(s.alias("start"), e.cast("string").alias("end")), F.struct(e.alias("start"), s.cast("string").alias("end"))))
    text = F.when(k == 0, objects).when(k == 1, F.to_json(F.array(F.array(s, e, s), F.array(e, s), F.array(s)))).otherwise(F.concat(s, F.lit(" - "), e))
    return table(spark, d, "orders").select("o_orderkey", F.explode(N.interval_items(text)).alias("p")).select("o_orderkey", "p.s", "p.e")


@query("grader_reports", """SELECT l_orderkey, 'overall' AS dim, NULL::DOUBLE AS value, min(l_quantity) > 5 AS ok FROM lineitem GROUP BY l_orderkey UNION ALL SELECT l_orderkey, 'price', max(l_linenumber)::DOUBLE, max(l_linenumber) > 3 FROM lineitem GROUP BY l_orderkey UNION ALL SELECT l_orderkey, 'share', count(*)::DOUBLE, NULL FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, 'whole', (max(l_linenumber) > 3)::INTEGER::DOUBLE, max(l_linenumber) > 3 FROM lineitem GROUP BY l_orderkey""")
def _(spark, d):
    """Reports with a verdict, an object, a number and a boolean as dimensions, behind a line of text."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("q"), F.max("l_linenumber").alias("m"), F.count("*").alias("n"))
    dims = F.to_json(F.struct(F.struct(F.col("m").alias("value"), (F.col("m") > 3).alias("ok")).alias("price"), F.col("n").alias("share"), (F.col("m") > 3).alias("whole")))
    shown = F.concat(F.lit('grading...\n{"pass": '), (F.col("q") > 5).cast("string"), F.lit(', "dims": '), dims, F.lit("}"))
    reports = g.select("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, shown).otherwise(F.concat(F.lit('{"dims": '), dims, F.lit("}"))).alias("out"), F.when(F.col("l_orderkey") % 2 == 1, F.when(F.col("q") > 5, "Overall: PASS").otherwise("Overall: FAIL")).alias("err"))
    overall = reports.select("l_orderkey", F.lit("overall").alias("dim"), F.lit(None).cast("double").alias("value"), E.grader_pass(F.col("out"), F.col("err")).alias("ok"))
    return overall.unionByName(E.grader_dimensions(reports, "l_orderkey", "out"))


def _run_messages(spark, d):
    """Conversations as agent runs: an assistant's turn makes a call whose kind goes by the turn; a tool's reply follows it."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    k = F.col("turn") % 6
    command = F.when(k == 0, "ffmpeg -i clip.mp4").when(k == 1, "cat /etc/passwd").when(k == 2, "curl http://x.org").when(k == 3, "python a.py").when(k == 4, "ls /tmp").otherwise("sox a.wav")
    name = F.when(F.col("turn") % 7 == 6, "browser").otherwise("execute_commands")
    calls = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("place"), name.alias("name"), command.alias("command"), (F.col("turn") % 11 == 10).alias("malformed"))
    reply = F.when(k == 3, "  File a.py\nSyntaxError: invalid syntax").otherwise("done")
    replies = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("place"), F.lit("tool").alias("role"), reply.alias("text"))
    return calls, replies


@query("tool_summary", """WITH c AS (SELECT conv_id, turn, turn % 6 AS k, turn % 7 = 6 AS other, turn % 11 = 10 AS bad FROM conversations WHERE role = 'assistant')
SELECT conv_id, count(*) AS n_tool, count(*) FILTER (WHERE bad) AS n_unparseable, count(*) FILTER (WHERE NOT bad AND other) + count(*) FILTER (WHERE NOT bad AND k = 2) AS n_disallowed, count(*) FILTER (WHERE NOT bad AND k = 1) AS n_escape, count(*) FILTER (WHERE k = 3) AS n_syntax_fail,
(count(*) FILTER (WHERE bad) + count(*) FILTER (WHERE NOT bad AND other) + count(*) FILTER (WHERE NOT bad AND k = 2) + count(*) FILTER (WHERE NOT bad AND k = 1) + count(*) FILTER (WHERE k = 3)) / (1 + count(*))::DOUBLE AS p_bad_tool FROM c GROUP BY conv_id""")
def _(spark, d):
    calls, replies = _run_messages(spark, d)
    return W.tool_summary(calls, replies, "conv_id", "/work/job").drop("names")


@query("trajectory_reward", """WITH c AS (SELECT conv_id, turn, turn % 6 AS k, turn % 7 = 6 AS other, turn % 11 = 10 AS bad FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, count(*) AS n_tool, count(*) FILTER (WHERE bad) + count(*) FILTER (WHERE NOT bad AND other) + count(*) FILTER (WHERE NOT bad AND k = 2) + count(*) FILTER (WHERE NOT bad AND k = 1) + count(*) FILTER (WHERE k = 3) AS n_fail, count(*) FILTER (WHERE NOT bad AND k = 1) AS n_escape, bool_or(k = 0) AS video, bool_or(k = 5) AS audio FROM c GROUP BY conv_id),
t AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT t.conv_id, coalesce(n_tool, 0) AS n_tool, coalesce(n_fail, 0) AS n_fail, coalesce(n_escape, 0) AS n_escape, CASE WHEN t.conv_id % 5 <> 0 THEN CASE WHEN t.conv_id % 2 = 0 THEN 1 ELSE 0 END END AS guess, t.conv_id % 4 = 0 AS late, t.conv_id % 3 = 0 AS has_v, t.conv_id % 7 = 0 AS has_a, (t.conv_id % 3 <> 0 OR coalesce(video, false)) AND (t.conv_id % 7 <> 0 OR coalesce(audio, false)) AS fit FROM t LEFT JOIN s USING (conv_id)),
z AS (SELECT *, CASE WHEN coalesce(guess, 0) = 1 AND fit AND n_tool > 0 AND n_escape = 0 THEN 1.0 ELSE 0.0 END AS correctness, guess IS NULL AND late AS gone FROM r)
SELECT conv_id, correctness::DOUBLE AS correctness, gone AS removed, CASE WHEN gone THEN 0.0 ELSE CASE WHEN correctness = 1 THEN 1.0 WHEN guess IS NOT NULL AND NOT late THEN 0.2 ELSE -0.2 END + CASE WHEN (has_v OR has_a) AND NOT fit THEN -0.3 ELSE 0.0 END - 0.5 * n_fail::DOUBLE / (1 + n_tool) END::DOUBLE AS score FROM z""")
def _(spark, d):
    """Whole flow: calls and replies to a summary, the answer to an outcome, media to a modality check, all to a score."""
    calls, replies = _run_messages(spark, d)
    k = F.col("conv_id")
    said = F.when(k % 5 != 0, F.when(k % 2 == 0, "so <answer>The Cat;dog and cow</answer>").otherwise("<answer>cow</answer>")).otherwise("no idea")
    runs = table(spark, d, "conversations").select("conv_id").distinct().select(
        "conv_id", X.last_answer(said).alias("prediction"), F.when(k % 4 == 0, "timeout").otherwise("task_complete").alias("exit_reason"), F.array(F.lit("the cat dog cow"), F.lit("x")).alias("truths"),
        F.when(k % 3 == 0, F.array(F.lit("v.mp4"))).alias("videos"), F.when(k % 7 == 0, F.array(F.lit("a.wav"))).alias("audios"))
    return W.rewarded(runs, W.tool_summary(calls, replies, "conv_id", "/work/job"), "conv_id", ("ffmpeg",), ("sox",), ("identify",)).select("conv_id", "correctness", "removed", "score")


@query("converted_conversation", """WITH c AS (SELECT *, CASE WHEN role = 'assistant' THEN lead(role) OVER (PARTITION BY conv_id ORDER BY turn) END AS nx FROM conversations WHERE coalesce(trim(text), '') <> ''), k AS (SELECT * FROM c WHERE role <> 'assistant' OR nx IS DISTINCT FROM 'assistant')
SELECT conv_id, count(*) + 2 * max((role = 'assistant')::INTEGER) AS messages, max((role = 'assistant')::INTEGER)::BIGINT AS completions FROM k GROUP BY conv_id""")
def _(spark, d):
    """Blank messages go, runs of assistant messages become their last, the answer and a completion are at the end."""
    t = F.when(F.col("role") == "assistant", F.concat("text", F.lit(" <answer>x</answer>"))).otherwise(F.col("text"))
    m = table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.trim(F.coalesce("text", F.lit(""))) != "", t).alias("text"))
    rows = P.converted(m, "conv_id", "turn", "role", "text", reminder="please call a tool now")
    done = F.size(F.filter("messages", lambda x: (x["role"] == "tool_call") & x["text"].contains("task_complete"))).cast("long")
    return rows.select("conv_id", F.size("messages").cast("long").alias("messages"), done.alias("completions"))
