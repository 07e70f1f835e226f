"""Queries for whole evaluations and for judgements of varied table values: reports, filtering with errors set apart, extraction, training sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import conversation as C
from millrace.operators import intervals as I  # noqa: E741
from millrace.operators import joins as J
from millrace.operators import matching as A
from millrace.operators import report as R
from millrace.operators import select as S
from millrace.plans import flows as P
from millrace.plans import specs
from millrace.plans.base import EV, events, query, table
from millrace.plans.composite import _SCORED, _evaluated


def _leveled(spark, d):
    ann, pred, scored = _evaluated(spark, d)
    q = F.col("question_id")
    pred = pred.select("question_id", "prediction", F.when(q % 3 == 0, (q % 5).cast("string")).alias("level1_answer"), F.when(q % 2 == 0, F.concat(F.lit(" "), "prediction", F.lit(" "))).alias("level2_answer"), F.when(q % 4 == 0, F.array(F.lit("1"), F.lit("3"), F.lit("x"))).alias("levels"))
    rows = P.leveled(scored, pred)
    return rows.withColumns({"language": F.concat(F.lit("l"), q % 3), "evidence_span": F.when(q % 7 > 0, F.concat(F.lit("s"), q % 7)), "capabilities": F.array_distinct(F.array(F.concat(F.lit("c"), q % 4), F.concat(F.lit("c"), q % 3)))})


_LEVELED = _SCORED + """, w AS (SELECT z.*, CASE WHEN z.q % 3 = 0 THEN CAST(z.q % 5 AS VARCHAR) = qs.answer END AS l1, CASE WHEN z.q % 2 = 0 THEN z.l3 END AS l2, CASE WHEN z.q % 4 = 0 THEN true ELSE z.q % 3 = 0 END AS a1, CASE WHEN z.q % 4 = 0 THEN false ELSE z.q % 2 = 0 END AS a2, z.q % 4 <> 0 AS a45x FROM z JOIN qs USING (q))"""
_PCT = "coalesce(avg({0}::INTEGER) * 100, 0)"


@query("evaluate_report", _LEVELED + " SELECT count(*) AS count, " + ", ".join(f"{_PCT.format(f'l{k}')} AS level{k}_accuracy, count(*) FILTER ({a}) AS level{k}_attempted_count, count(*) FILTER ({a} AND coalesce(l{k}, false)) AS level{k}_correct_count" for k, a in ((1, "a1"), (2, "a2"), (3, "true"), (4, "false"), (5, "false")))
       + ", avg(tiou) * 100 AS mean_tiou_all, coalesce(avg(tiou) FILTER (WHERE ht) * 100, 0) AS mean_tiou_annotated, avg(viou) * 100 AS mean_viou_all, coalesce(avg(viou) FILTER (WHERE hs) * 100, 0) AS mean_viou_annotated, "
       + ", ".join(f"{_PCT.format(c)} AS {n}_annotation_coverage" for c, n in (("ht", "temporal"), ("hs", "spatial"), ("(ht AND hs)", "spatio_temporal"))) + " FROM w")
def _(spark, d):
    return R.whole_report(_leveled(spark, d))


@query("evaluate_groups", _LEVELED + """, gr AS (SELECT 'category' AS dimension, category AS "group", * FROM w UNION ALL SELECT 'language', 'l' || q % 3, * FROM w UNION ALL SELECT 'evidence_span', CASE WHEN q % 7 > 0 THEN 's' || q % 7 ELSE '' END, * FROM w
UNION ALL SELECT 'capability', 'c' || q % 4, * FROM w UNION ALL SELECT 'capability', 'c' || q % 3, * FROM w WHERE q % 3 <> q % 4)
SELECT dimension, "group", count(*) AS count, avg(l3::INTEGER) * 100 AS level3_accuracy, avg(l4::INTEGER) * 100 AS level4_accuracy, avg(l5::INTEGER) * 100 AS level5_accuracy, avg(tiou) * 100 AS mean_tiou_all, avg(viou) * 100 AS mean_viou_all FROM gr GROUP BY ALL""")
def _(spark, d):
    """By category, language and span, and by capability, of which a question has one or two."""
    return R.grouped_reports(_leveled(spark, d))


def _runs(spark, d):
    """Runs of conversations: results, items, and message files, of which some are cut off and some are missing."""
    c = table(spark, d, "conversations")
    k = F.col("conv_id")
    said = F.concat("text", F.when(F.col("role") == "assistant", F.concat(F.lit(" <answer>"), F.col("conv_id") % 3, F.lit("</answer>"))).otherwise(""))
    m = c.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("content"), F.max((F.col("role") == "assistant").cast("int")).alias("spoke"))  # of one conversation
    files = m.filter(k % 11 != 10).select(k.alias("source_index"), F.when(k % 7 == 6, F.substring("content", 1, 40)).otherwise(F.col("content")).alias("content"))
    runs = m.select(k.alias("source_index"), F.concat(F.lit("q"), k).alias("id"), F.when(k % 5 == 0, "2").otherwise("").alias("predicted"), F.when(k % 4 == 0, "timeout").otherwise("task_complete").alias("exit_reason"), F.lit(None).cast("string").alias("error"))
    items = m.filter(k % 13 != 12).select(F.concat(F.lit("q"), k).alias("id"), F.lit("mcq").alias("answer_type"), F.array(F.when(k % 2 == 0, "1").otherwise("2")).alias("ground_truth"))
    return runs, items, files


_FILTER = """WITH m AS (SELECT conv_id AS k, max((role = 'assistant')::INTEGER) AS spoke FROM conversations GROUP BY conv_id),
r AS (SELECT *, k % 7 = 6 AND k % 11 <> 10 AS broken, k % 11 = 10 AS missing, CASE WHEN k % 5 = 0 THEN '2' WHEN k % 7 = 6 OR k % 11 = 10 OR spoke = 0 THEN NULL ELSE CAST(k % 3 AS VARCHAR) END AS p, CASE WHEN k % 13 = 12 THEN NULL WHEN k % 2 = 0 THEN '1' ELSE '2' END AS g FROM m),
j AS (SELECT *, coalesce(p = g, false) AS ok, CASE WHEN p IS NULL THEN 'empty_prediction' WHEN g IS NULL THEN 'no_ground_truth' WHEN p = g THEN 'exact_match' ELSE 'no_match_mcq' END || CASE WHEN coalesce(p = g, false) AND k % 4 = 0 THEN ';rescue=on' ELSE '' END AS why FROM r) """


@query("data_filter_report", _FILTER + "SELECT 'q' || k AS id, k AS source_index, p AS predicted, ok AND NOT broken AS passed, CASE WHEN broken THEN 'row_error:bad_messages' WHEN ok AND missing THEN why || ';no_item_dir' ELSE why END AS reason FROM j")
def _(spark, d):
    """Rows that pass, rows whose message file is cut off or missing, and rows without an item."""
    report, _rows = P.data_filter(*_runs(spark, d), reminder="please call a tool now")
    return report.select("id", "source_index", "predicted", "passed", "reason")


@query("data_filter_rows", _FILTER + ", c AS (SELECT *, CASE WHEN role = 'assistant' THEN lead(role) OVER (PARTITION BY conv_id ORDER BY turn) END AS nx FROM conversations WHERE role = 'assistant' OR coalesce(trim(text), '') <> '') SELECT conv_id AS source_index, count(*) + 2 * max((role = 'assistant')::INTEGER) AS messages FROM c JOIN j ON k = conv_id WHERE ok AND NOT broken AND NOT missing AND (role <> 'assistant' OR nx IS DISTINCT FROM 'assistant') GROUP BY conv_id")
def _(spark, d):
    """The training conversations that filtering leaves, converted."""
    _report, rows = P.data_filter(*_runs(spark, d), reminder="please call a tool now")
    return rows.select("source_index", F.size("messages").cast("long").alias("messages"))


@query("archive_latest", f"WITH {EV} SELECT user_id, event_id, row_number() OVER w AS attempt, count(*) OVER (PARTITION BY user_id) AS attempts, lead(event_id) OVER w IS NOT NULL AS superseded FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)")
def _(spark, d):
    rows = S.archived(events(spark, d).select("user_id", "event_id", "sec"), ["user_id"], ["sec", "event_id"])
    return rows.select("user_id", "event_id", F.col("attempt").cast("long").alias("attempt"), "attempts", "superseded")


@query("correctness_of_names", r"""WITH n AS (SELECT p_partkey AS k, p_size % 2 = 0 AS mcq, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name || '!' END AS p, [lead(p_name) OVER w, lead(upper(split_part(p_name, ' ', 1))) OVER w] AS t FROM part WINDOW w AS (ORDER BY p_partkey)),
m AS (SELECT k, mcq, lower(replace(p, '!', '')) AS p, list_transform(list_filter(t, lambda x: x IS NOT NULL), lambda x: lower(x)) AS t FROM n), o AS (SELECT *, list_filter(t, lambda x: contains(p, x) OR contains(x, p)) AS w, split_part(p, ' ', 1) AS tok FROM m)
SELECT k AS p_partkey, CASE WHEN p = '' THEN 'empty_prediction' WHEN mcq AND list_contains(t, p) THEN 'exact_match' WHEN mcq AND len(list_filter(t, lambda x: x = tok OR starts_with(x, tok || ' '))) > 0 THEN 'first_token_match' WHEN mcq THEN 'no_match_mcq' WHEN len(w) > 0 THEN CASE WHEN contains(p, w[1]) THEN 'open_substring(g_in_p=True)' ELSE 'open_substring(g_in_p=False)' END ELSE 'no_match_open' END AS reason FROM o""")
def _(spark, d):
    """A part's name as the answer, the next part's name and its first word as the truths."""
    p = table(spark, d, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n"))
    said = F.when(F.col("p_size") % 9 == 0, "").otherwise(F.concat("p_name", F.lit("!")))
    truths = F.array(F.col("n"), F.upper(F.substring_index("n", " ", 1)))
    v = X.correctness(F.when(F.col("p_size") % 2 == 0, "mcq").otherwise("open"), said, truths)
    return p.join(nxt, "p_partkey", "left").select("p_partkey", v["reason"].alias("reason"))


@query("clock_of_events", f"WITH {EV}, t AS (SELECT event_id, sec % 86400 AS s, cents % 100 AS c FROM ev) SELECT event_id, CASE WHEN event_id % 5 < 3 THEN s + c / 100.0::DOUBLE WHEN event_id % 5 = 3 THEN CAST(s AS DOUBLE) END AS seconds FROM t")
def _(spark, d):
    """Times of day as H:M:S with a comma or a dot, as minutes and seconds, as a number, and with a word."""
    s, c, k = F.col("sec") % 86_400, F.lpad(F.col("cents") % 100, 2, "0"), F.col("event_id") % 5
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    said = (
        F.when(k == 0, F.concat(h, F.lit(":"), F.lpad(m, 2, "0"), F.lit(":"), F.lpad(r, 2, "0"), F.lit(","), c)).when(k == 1, F.concat(F.lit(" "), F.lpad(h, 2, "0"), F.lit(":"), m, F.lit(":"), r, F.lit("."), c))
        .when(k == 2, F.concat(F.floor(s / 60), F.lit(":"), r, F.lit("."), c)).when(k == 3, s.cast("string")).otherwise(F.concat(s, F.lit(" s")))
    )
    return events(spark, d).select("event_id", X.clock_seconds(said).alias("seconds"))


@query("recovered_calls", r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '["\\\x00-\x1f<]', ' ', 'g') AS t, turn % 3 AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN ['{"name": "a", "arguments": {"x": "' || t || '"}}', '{"name": "b", "arguments": {"y": ["' || t || '"]}}'] WHEN 1 THEN ['{"name": "a", "arguments": {"x": "' || t || '"}}'] ELSE [] END AS calls FROM t""")
def _(spark, d):
    """A whole call and one that is cut off within a turn's text; a whole one; and a body that is no object."""
    t = F.regexp_replace("text", r'["\\\x00-\x1f<]', " ")
    whole, cut = F.concat(F.lit('<tool_call>\n{"name": "a", "arguments": {"x": "'), t, F.lit('"}}</tool_call>')), F.concat(F.lit('<TOOL_CALL>{"name": "b", "arguments": {"y": ["'), t)
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("so "), whole, F.lit(" and "), cut)).when(F.col("turn") % 3 == 1, F.concat(whole, F.lit("<tool_call>none</tool_call>"))).otherwise(F.concat(F.lit("<tool_call>["), F.lit("1]</tool_call>"), t))
    return table(spark, d, "conversations").select("conv_id", "turn", C.recovered_calls(said).alias("calls"))


@query("paired_images", "WITH m AS (SELECT conv_id, turn FROM conversations) SELECT a.conv_id, a.turn AS call_place, b.turn AS response_place FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.turn % 4 < 2 AND b.turn = a.turn + 2 AND (a.conv_id + a.turn) % 3 > 0")
def _(spark, d):
    """Turns in fours: two calls, then their responses; some calls are not of images."""
    c = table(spark, d, "conversations")
    call = F.concat(F.lit('{"name": "'), F.when((F.col("conv_id") + F.col("turn")) % 3 > 0, "image_read").otherwise("execute_commands"), F.lit('"}'))
    m = c.select("conv_id", "turn", F.when(F.col("turn") % 4 < 2, "tool_call").otherwise("tool_response").alias("role"), F.when(F.col("turn") % 4 < 2, call).otherwise(F.col("text")).alias("text"))
    return C.paired_images(m, "conv_id", "turn", "role", "text")


@query("training_sequences", "WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber % 2 AS mask, -l_discount AS lp FROM lineitem) SELECT l_orderkey, count(*) AS tokens, sum(mask)::BIGINT AS trained, round(sum(mask * lp), 6) AS log_prob FROM l GROUP BY l_orderkey")
def _(spark, d):
    """A sequence of each order's lines: token, whether it is trained on, and its log probability, side by side."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", (F.col("l_linenumber") % 2).cast("int").alias("mask"), (-F.col("l_discount")).cast("double").alias("lp")).alias("x"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # of one order
    rows = g.select("l_orderkey", F.explode(C.aligned(F.col("xs.l_partkey"), F.col("xs.mask"), F.col("xs.lp"))).alias("e"))
    return rows.groupBy("l_orderkey").agg(F.count("e.token").alias("tokens"), F.sum("e.mask").cast("long").alias("trained"), F.round(F.sum(F.col("e.mask") * F.col("e.log_prob")), 6).alias("log_prob"))


@query("confidence_matching", f"""WITH RECURSIVE {EV}, c AS (SELECT user_id, event_id, sec, row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id) AS i FROM ev WHERE event_type = 'click'),
p0 AS (SELECT c.user_id AS key, c.i, c.event_id, b.event_id AS j, CAST(7200 - abs(c.sec - b.sec) AS DOUBLE) AS score FROM c JOIN ev b ON c.user_id = b.user_id AND b.event_type = 'view' AND abs(c.sec - b.sec) < 7200), p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i, score DESC, j) AS r FROM p0),
s AS (SELECT key, 0::BIGINT AS r, []::BIGINT[] AS li, []::BIGINT[] AS rj, false AS taken FROM (SELECT DISTINCT key FROM p) UNION ALL
SELECT p.key, p.r, CASE WHEN list_contains(li, p.i) OR list_contains(rj, p.j) THEN li ELSE list_append(li, p.i) END, CASE WHEN list_contains(li, p.i) OR list_contains(rj, p.j) THEN rj ELSE list_append(rj, p.j) END, NOT (list_contains(li, p.i) OR list_contains(rj, p.j)) FROM s JOIN p ON p.key = s.key AND p.r = s.r + 1)
SELECT key AS user_id, event_id, j FROM s JOIN p USING (key, r) WHERE taken""")
def _(spark, d):
    """Clicks from the most confident on, each with the nearest view of its user that is still free."""
    from millrace.plans.sequence import _pairs

    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("cents"), "event_id"))
    rank = events(spark, d).filter("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("event_id").alias("click"), place.alias("place"), "event_id")
    pairs = _pairs(spark, d).withColumnRenamed("i", "click").join(rank.drop("event_id"), ["key", "click"])
    taken = A.match(pairs.select("key", F.col("place").alias("i"), "j", "score"), "key", "ordered")
    return taken.join(rank.select("key", F.col("place").cast("long").alias("i"), "click"), ["key", "i"]).select(F.col("key").alias("user_id"), F.col("click").alias("event_id"), "j")


@query("spec_prompts", """SELECT 'option_text' AS bench, 'x' || p_partkey AS id, p_name || '?' || chr(10) || '  A. ' || p_brand || chr(10) || '  B. ' || p_type || chr(10) || chr(10) || 'Answer with <answer>A</answer>, one option letter.' AS prompt FROM part WHERE p_size % 2 = 0
UNION ALL SELECT 'exact_answer', p_brand, string_agg(row || '. ' || p_name || '?', chr(10) ORDER BY row) || chr(10) || chr(10) || 'Answer each question with Final Answer: and a short text.' FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row FROM part WHERE p_size % 2 = 1) GROUP BY p_brand""")
def _(spark, d):
    """Prompts by a benchmark's specification: an item each, or, where a group is asked at once, a numbered list of its questions."""
    p = table(spark, d, "part").select(F.concat(F.lit("x"), "p_partkey").alias("question_id"), F.col("p_partkey").alias("source_index"), F.concat("p_name", F.lit("?")).alias("question"), F.array("p_brand", "p_type").alias("options"), F.col("p_brand").alias("video"), "p_size")
    one = specs.prompts(p.filter("p_size % 2 = 0"), "option_text")
    group = specs.prompts(p.filter("p_size % 2 = 1").drop("options"), "exact_answer")
    return one.select(F.lit("option_text").alias("bench"), "id", "prompt").unionAll(group.select(F.lit("exact_answer").alias("bench"), "id", "prompt"))


@query("clipped_tiou", f"""WITH {EV}, t AS (SELECT user_id, event_id, sec AS s, sec + 5000 AS e FROM ev WHERE event_type = 'click'), v AS (SELECT user_id, sec AS s, sec + cents AS e FROM ev WHERE event_type = 'view' AND cents > 0),
a AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v), i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS g FROM a),
f AS (SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, g), n AS (SELECT user_id, sum(e - s) AS n FROM f GROUP BY user_id),
c AS (SELECT t.event_id, t.user_id, sum(greatest(0, least(f.e, t.e) - greatest(f.s, t.s))) AS c, sum(greatest(0, least(f.e, t.e + 600) - greatest(f.s, t.s - 600))) AS w FROM t JOIN f ON t.user_id = f.user_id GROUP BY ALL)
SELECT c.event_id, least(1.0::DOUBLE, least(w, n, 6200) / (n + 5000 - c)::DOUBLE) AS clipped_iou FROM c JOIN n USING (user_id)""")
def _(spark, d):
    """Of each click's stretch of time, what the views of its user cover, ten minutes forgiven."""
    e = events(spark, d)
    truth = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("_id"), F.col("sec").alias("s"), (F.col("sec") + 5000).alias("e"))
    found = e.filter("event_type = 'view'").select("user_id", F.col("sec").alias("s"), (F.col("sec") + F.col("cents")).alias("e"))
    return I.clipped_iou(truth, found, ["user_id"], 600).select(F.col("_id").alias("event_id"), "clipped_iou")


@query("dominant_label", "WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL), t AS (SELECT l_suppkey, arg_max(l_returnflag, {'n': n, 'f': -f}) AS label FROM c GROUP BY l_suppkey) SELECT p_partkey, p_partkey % 97 AS s, label FROM part LEFT JOIN t ON l_suppkey = p_partkey % 97")
def _(spark, d):
    """Parts matched to suppliers, and the flag that most of the supplier's lines bear."""
    matches = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 97).alias("s"))
    labels = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return J.dominant_label(matches, labels, "p_partkey", "s", "label", "place")


@query("missing_side_labels", "SELECT coalesce(lang, '?') AS predicted, coalesce(CAST(quality AS VARCHAR), 'MISSING') AS true, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"))
    return J.labelled_pairs(docs, table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("q")), "doc_id", "lang", "q")


@query("required_match", "SELECT count(*) AS loaded, count(l.doc_id) AS matched, count(*) - count(l.doc_id) AS unmatched FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def _(spark, d):
    return J.required_match(J.matched(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id"))


@query("typed_event_matching", f"""WITH RECURSIVE {EV}, p0 AS (SELECT a.user_id || a.event_type AS key, a.event_id AS i, b.event_id AS j, abs(a.sec - b.sec) AS far FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND abs(a.sec - b.sec) <= 20000),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i, far, j) AS r FROM p0),
s AS (SELECT key, 0::BIGINT AS r, []::BIGINT[] AS li, []::BIGINT[] AS rj, false AS taken FROM (SELECT DISTINCT key FROM p) UNION ALL
SELECT p.key, p.r, CASE WHEN list_contains(li, p.i) OR list_contains(rj, p.j) THEN li ELSE list_append(li, p.i) END, CASE WHEN list_contains(li, p.i) OR list_contains(rj, p.j) THEN rj ELSE list_append(rj, p.j) END, NOT (list_contains(li, p.i) OR list_contains(rj, p.j)) FROM s JOIN p ON p.key = s.key AND p.r = s.r + 1)
SELECT i, j FROM s JOIN p USING (key, r) WHERE taken""")
def _(spark, d):
    """True events in their order, each with the nearest found one of its user and type that is still free."""
    e = events(spark, d).withColumn("key", F.concat(F.col("user_id"), "event_type"))
    a = e.filter("event_id % 2 = 0").select("key", F.col("event_id").alias("i"), F.col("sec").alias("s"), (F.col("sec") + 20_001).alias("e"))
    b = e.filter("event_id % 2 = 1").select("key", F.col("event_id").alias("j"), F.col("sec").alias("s2"), (F.col("sec") + 20_001).alias("e2"))
    pairs = I.overlap_pairs(a, b, ["key"], 40_000).select("key", "i", "j", (-F.abs(F.col("s") - F.col("s2"))).cast("double").alias("score"))
    return A.match(pairs, "key", "ordered").select("i", "j")


@query("selected_order", "SELECT row_number() OVER (ORDER BY p_brand, CAST(p_partkey AS VARCHAR)) AS place, p_brand AS benchmark, CAST(p_partkey AS VARCHAR) AS item_id FROM part")
def _(spark, d):
    """Selected items in order of benchmark and of the item's id as text, numbered without a task that sees all."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("benchmark"), F.col("p_partkey").cast("string").alias("item_id"))
    return S.numbered(p, [F.col("benchmark"), F.col("item_id")], [F.col("benchmark")], "place").select("place", "benchmark", "item_id")
