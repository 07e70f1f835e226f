"""Queries for whole dataflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import report as R
from millrace.plans import flows as P
from millrace.plans.base import EV, events, query, table


def _evaluated(spark, d):
    e = events(spark, d).withColumn("question_id", F.col("user_id"))
    ann = e.groupBy("question_id").agg((F.max("event_id") % 5).cast("string").alias("answer"), F.min("event_type").alias("category"))
    pred = e.groupBy("question_id").agg((F.min("event_id") % 5).cast("string").alias("prediction"))
    span = lambda k: e.filter(F.col("event_type") == k).select("question_id", F.col("sec").alias("s"), (F.col("sec") + F.col("cents") * 20).alias("e"))
    side = lambda k: e.filter(F.col("event_type") == k).select("question_id", F.floor(F.col("sec") / 3600).alias("t"), F.array(F.lit(0.0), F.lit(0.0), 0.2 + F.col("cents") / 20000, F.lit(0.5)).alias("b")).groupBy("question_id", "t").agg(F.array_sort(F.collect_list("b")).alias("boxes"))
    return ann, pred, P.evaluate(ann, pred, span("view"), span("click"), side("view"), side("click"), 2)


#: The evaluation in SQL. All boxes of a time begin at the origin and have one height, so their union is the widest.
_ISLANDS = """{n} AS (SELECT q, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY s, e) AS g FROM (SELECT *, max(e) OVER (PARTITION BY q ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sp WHERE event_type = '{k}' AND s < e)) GROUP BY q, g)"""
_SCORED = f"""WITH {EV}, sp AS (SELECT user_id AS q, event_type, sec AS s, sec + cents * 20 AS e FROM ev), {_ISLANDS.format(n="g", k="view")}, {_ISLANDS.format(n="f", k="click")},
c AS (SELECT g.q, sum(least(g.e, f.e) - greatest(g.s, f.s)) AS c FROM g JOIN f ON g.q = f.q AND g.s < f.e AND f.s < g.e GROUP BY 1), l AS (SELECT q, sum(e - s) AS gl FROM g GROUP BY 1), m AS (SELECT q, sum(e - s) AS fl FROM f GROUP BY 1),
ti AS (SELECT q, coalesce(coalesce(c, 0)::DOUBLE / nullif(gl + coalesce(fl, 0) - coalesce(c, 0), 0), 0) AS tiou FROM l LEFT JOIN m USING (q) LEFT JOIN c USING (q)),
bx AS (SELECT user_id AS q, event_type, sec // 3600 AS t, max(0.2::DOUBLE + cents / 20000.0::DOUBLE) AS w FROM ev WHERE event_type IN ('view', 'click') GROUP BY ALL),
nr AS (SELECT a.q, a.t, a.w, b.w AS w2, row_number() OVER (PARTITION BY a.q, a.t ORDER BY abs(a.t - b.t), b.t) AS r FROM bx a LEFT JOIN bx b ON a.q = b.q AND b.event_type = 'click' AND abs(a.t - b.t) <= 2 WHERE a.event_type = 'view'),
vi AS (SELECT q, avg(coalesce(least(w, w2) / greatest(w, w2) * (w2 IS NOT NULL)::INTEGER, 0)) AS viou FROM nr WHERE r = 1 GROUP BY q),
qs AS (SELECT user_id AS q, CAST(max(event_id) % 5 AS VARCHAR) AS answer, CAST(min(event_id) % 5 AS VARCHAR) AS prediction, min(event_type) AS category FROM ev GROUP BY 1),
sc AS (SELECT q, category, prediction, prediction = answer AS l3, ti.q IS NOT NULL AS ht, vi.q IS NOT NULL AS hs, coalesce(tiou, 0) AS tiou, coalesce(viou, 0) AS viou FROM qs LEFT JOIN ti USING (q) LEFT JOIN vi USING (q)),
z AS (SELECT *, l3 AND tiou > 0.3 AS l4, l3 AND tiou > 0.3 AND viou > 0.3 AS l5 FROM sc)"""
_LEVELS = "count(*) AS count, avg(l3::INTEGER) * 100 AS level3_accuracy, avg(l4::INTEGER) * 100 AS level4_accuracy, avg(l5::INTEGER) * 100 AS level5_accuracy, avg(tiou) * 100 AS mean_tiou_all, coalesce(avg(tiou) FILTER (WHERE ht) * 100, 0) AS mean_tiou_annotated, avg(viou) * 100 AS mean_viou_all, coalesce(avg(viou) FILTER (WHERE hs) * 100, 0) AS mean_viou_annotated"


@query("evaluate_levels", f"{_SCORED} SELECT {_LEVELS} FROM z")
def _(spark, d):
    return R.level_report(_evaluated(spark, d)[2])


@query("evaluate_by_category", f"{_SCORED} SELECT category, {_LEVELS} FROM z GROUP BY category")
def _(spark, d):
    return R.level_report(_evaluated(spark, d)[2], "category")


@query("evaluate_questions", f"{_SCORED} SELECT q AS question_id, prediction, CASE WHEN q % 7 <> 0 THEN l3 END AS l3_correct, CASE WHEN q % 7 <> 0 THEN tiou END AS tiou, CASE WHEN q % 7 <> 0 THEN viou END AS viou, CASE WHEN q % 7 <> 0 THEN l4 END AS l4_correct, CASE WHEN q % 7 <> 0 THEN l5 END AS l5_correct, q % 7 <> 0 AS eval_matched_annotation, CASE WHEN q % 7 = 0 THEN 'question_id not found in annotations' END AS eval_error FROM z")
def _(spark, d):
    ann, pred, scored = _evaluated(spark, d)
    return P.question_rows(pred, scored.filter("question_id % 7 <> 0"))


@query("prompt_parity", "SELECT * FROM (VALUES ('only_left', (SELECT count(*) FROM documents WHERE doc_id % 10 = 3)), ('only_right', CAST(0 AS BIGINT)), ('repeated_keys', CAST(0 AS BIGINT)), ('different', (SELECT count(*) FROM documents WHERE doc_id % 10 = 5)), ('first_difference', CAST(0 AS BIGINT))) v(\"check\", n)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(" /tmp/a1")).alias("p"))
    other = docs.filter("doc_id % 10 <> 3").withColumn("p", F.when(F.col("doc_id") % 10 == 5, F.concat(F.lit("y"), "p")).otherwise(F.replace("p", F.lit("a1"), F.lit("b2"))))
    return P.parity(docs, other, "doc_id", "p")


@query("bench_subset", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 50")
def _(spark, d):
    return P.subset(table(spark, d, "part").select("p_partkey"), "p_partkey", "p_partkey", 50)


@query("escalation_pass", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS attempt, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN o_orderkey % 2 = 0 ELSE true END AS ok FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    first = table(spark, d, "orders").select("o_orderkey", (k % 3 != 0).alias("ok"), F.when(k % 5 == 0, "e").alias("error"))
    second = first.select("o_orderkey", (k % 2 == 0).alias("ok"), F.lit(None).cast("string").alias("error"))
    return P.escalated(first, second, "o_orderkey", "ok", "error").select("o_orderkey", "attempt", "ok")


@query("item_filters", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_size % 2 = 0 ORDER BY p_partkey LIMIT 30")
def _(spark, d):
    items = table(spark, d, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.col("p_partkey").alias("source_index"))
    return P.selected(items, categories=["Brand#1", "Brand#2"], most=30).select(F.col("id").alias("p_partkey"))


@query("capacity_stats", f"WITH {EV} SELECT count(*) AS requests, sum(event_id)::BIGINT AS tokens, sum(cents)::DOUBLE / count(*) AS mean, list_sort(list(cents))[CAST(floor(count(*) * 0.9::DOUBLE + 0.999) AS BIGINT)] AS p90, list_sort(list(cents))[CAST(floor(count(*) * 0.99::DOUBLE + 0.999) AS BIGINT)] AS p99, max(user_id) AS longest_queue, (SELECT count(*) FROM ev WHERE event_id % 3 = 1) AS rank1 FROM ev")
def _(spark, d):
    e = events(spark, d).withColumn("rank", F.col("event_id") % 3)
    return P.capacity(e, "cents", "event_id", "rank", "user_id").withColumn("rank1", F.col("by_rank")["1"]).drop("by_rank")


@query("gauge_fold", f"WITH {EV} SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN sum(cents) ELSE max(cents) END::BIGINT AS value FROM ev GROUP BY event_type")
def _(spark, d):
    return P.gauge_fold(events(spark, d), "event_type", "cents", ["click", "view"])


@query("majority_vote", f"WITH {EV}, v AS (SELECT user_id, count(*) FILTER (WHERE cents >= 5000) AS y, count(*) FILTER (WHERE cents < 5000) AS n, avg(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS s FROM ev GROUP BY user_id) SELECT user_id, CASE WHEN y = n THEN s >= 0.5 ELSE y > n END AS passed FROM v")
def _(spark, d):
    e = events(spark, d).select("user_id", (F.col("cents") >= 5000).alias("vote"), F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(0.0).alias("s"))
    return P.majority(e, "user_id", "vote", "s")


@query("yes_share", "SELECT l_orderkey, sum(CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_quantity > 25 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS yes_share FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_quantity") > 25).cast("int")).alias("a"))
    return P.yes_share(a, "l_orderkey", "a")


@query("best_theta_match", "WITH m AS (SELECT a.l_orderkey * 10 + a.l_linenumber AS l, b.l_orderkey * 10 + b.l_linenumber AS r, least(a.l_quantity, b.l_quantity) / greatest(a.l_quantity, b.l_quantity) AS s FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 = 0 AND b.l_linenumber % 2 = 1), w AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) AS n FROM m) SELECT l, r AS \"right\", s AS score FROM w WHERE n = 1 AND s >= 0.5")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a = li.filter("l_linenumber % 2 = 0").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l"), F.col("l_quantity").alias("x"))
    b = li.filter("l_linenumber % 2 = 1").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("r"), F.col("l_quantity").alias("y"))
    return P.best_match(a.join(b, "l_orderkey").withColumn("s", F.least("x", "y") / F.greatest("x", "y")), "l", "s", "r", 0.5)


@query("synonym_mapping", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'look' WHEN event_type = 'purchase' THEN 'buy' ELSE event_type END AS event_type FROM events")
def _(spark, d):
    s = spark.createDataFrame([("look", ["Click", "VIEW"]), ("buy", ["purchase"])], "canonical string, names array<string>")
    return P.canonical_values(table(spark, d, "events").select("event_id", "event_type"), "event_type", s)


@query("speaker_spans", "WITH t AS (SELECT *, sum(CASE WHEN role = prev THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)) SELECT conv_id, role, min(turn) AS first_place, max(turn) AS last_place, md5(string_agg(text, ' ' ORDER BY turn)) AS h FROM t GROUP BY conv_id, g, role")
def _(spark, d):
    s = P.speaker_spans(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return s.select("conv_id", "role", "first_place", "last_place", F.md5(F.col("joined").cast("binary")).alias("h"))


@query("rms_windows", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, list_transform(range(0, greatest(len(v) - 16, -1) + 1, 8), lambda i: sqrt(list_sum(list_transform(v[i + 1:i + 16], lambda x: x * x)) / 16)) AS rms FROM v")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", P.rms_windows(F.transform("embedding", lambda x: x.cast("double")), 16, 8).alias("rms"))
