"""Queries for selection, joins, sets, aggregates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins as J
from millrace.operators import metrics as M
from millrace.operators import quality as Q
from millrace.operators import report as R
from millrace.operators import reward as W
from millrace.operators import select as S
from millrace.plans.base import EV, events, query, table

_VERDICT = "CASE WHEN event_type = 'signup' THEN NULL ELSE cents >= 5000 END"


def _graded(spark, d):
    verdict = F.when(F.col("event_type") != "signup", F.col("cents") >= 5000)
    return events(spark, d).select("event_id", "event_type", (F.col("user_id") % 3).alias("tier"), verdict.alias("is_correct"), F.when(F.col("cents") % 7 != 0, "x").alias("prediction"), (F.col("cents") % 5).cast("int").alias("tool_call_num"))


_GRADED = f"g AS (SELECT event_id, event_type, user_id % 3 AS tier, {_VERDICT} AS is_correct, CASE WHEN cents % 7 <> 0 THEN 'x' END AS prediction, cents % 5 AS tool_call_num FROM ev)"
_BLOCK = """count(*) AS count, count(*) FILTER (WHERE is_correct) AS correct_count, coalesce(count(*) FILTER (WHERE is_correct) / nullif(count(is_correct), 0)::DOUBLE, 0) AS accuracy,
  count(prediction) / count(*)::DOUBLE AS non_empty_ratio, sum(tool_call_num) / count(*)::DOUBLE AS avg_tool_calls"""


@query("accuracy_grouping_sets", f"""WITH {EV}, {_GRADED} SELECT 'overall' AS level, NULL AS "group", {_BLOCK} FROM g
UNION ALL SELECT 'event_type', event_type, {_BLOCK} FROM g GROUP BY event_type UNION ALL SELECT 'tier', CAST(tier AS VARCHAR), {_BLOCK} FROM g GROUP BY tier""")
def _(spark, d):
    return M.accuracy_report(_graded(spark, d), ["event_type", "tier"])


@query("accuracy_by_key", f"WITH {EV}, {_GRADED} SELECT event_type, {_BLOCK} FROM g GROUP BY event_type")
def _(spark, d):
    return _graded(spark, d).groupBy("event_type").agg(*M.accuracy_block())


@query("run_audit", f"""WITH {EV}, {_GRADED} SELECT event_type, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, count(*) FILTER (WHERE NOT is_correct) AS incorrect,
  count(*) FILTER (WHERE is_correct IS NULL) AS skipped, count(*) FILTER (WHERE prediction IS NULL) AS empty_pred, count(*) FILTER (WHERE is_correct) / count(*)::DOUBLE AS accuracy_all,
  coalesce(count(*) FILTER (WHERE is_correct) / nullif(count(is_correct), 0)::DOUBLE, 0) AS accuracy_scored, sum(tool_call_num) / count(*)::DOUBLE AS avg_tool_call_num FROM g GROUP BY event_type""")
def _(spark, d):
    return M.run_audit(_graded(spark, d), "event_type", "is_correct", "prediction", ["tool_call_num"])


@query("exit_reason_histogram", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 0) AS n_even, count(*) FILTER (WHERE user_id % 2 <> 0) AS n_odd FROM events GROUP BY event_type")
def _(spark, d):
    side = F.when(F.col("user_id") % 2 == 0, "n_even").otherwise("n_odd")
    p = table(spark, d, "events").withColumn("side", side).groupBy("event_type").pivot("side", ["n_even", "n_odd"]).count().fillna(0)
    return p.withColumn("n", F.col("n_even") + F.col("n_odd"))


@query("best_attempt_per_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def _(spark, d):
    return S.best_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), ["o_custkey"], [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), F.desc("o_orderkey")]).drop("o_orderstatus")


@query("latest_per_key", f"WITH {EV} SELECT user_id, event_id, sec FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1")
def _(spark, d):
    return S.latest_per_key(events(spark, d).select("user_id", "event_id", "sec"), ["user_id"], "sec", "event_id")


@query("archive_prior", f"WITH {EV} SELECT user_id, event_id, count(*) OVER w AS n_prior, coalesce(sum(event_id) OVER w, 0)::BIGINT AS id_sum FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    p = S.with_prior(events(spark, d).select("user_id", "event_id", "sec"), ["user_id"], ["sec", "event_id"], ["event_id"])
    return p.select("user_id", "event_id", F.size("prior").cast("long").alias("n_prior"), F.aggregate("prior", F.lit(0).cast("long"), lambda a, x: a + x["event_id"]).alias("id_sum"))


@query("keyed_shard_merge", "WITH s AS (SELECT o_orderkey % 500 AS k, o_orderkey AS v, 'shard_' || (o_orderkey % 4) AS path FROM orders) SELECT k, arg_max(v, {'p': path, 'v': v}) AS v FROM s GROUP BY k")
def _(spark, d):
    s = table(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("k"), F.col("o_orderkey").alias("v"), F.concat(F.lit("shard_"), F.col("o_orderkey") % 4).alias("path"), F.col("o_orderkey").alias("place"))
    return S.merge_shards(s, ["k"], "path", "place").select("k", "v")


@query("topk_tiebreak", "SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) ORDER BY n DESC, p_brand LIMIT 5")
def _(spark, d):
    return S.top_k(table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")), 5, "n", "p_brand")


@query("first_n_subset", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return S.first_n(table(spark, d, "documents").select("doc_id", "lang"), 100, "doc_id")


@query("filter_then_limit", "SELECT doc_id, lang FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 40")
def _(spark, d):
    return S.filter_then_limit(table(spark, d, "documents").select("doc_id", "lang"), F.col("lang") == "de", 40, "doc_id")


@query("numeric_key_order", "SELECT k, row_number() OVER (ORDER BY try_cast(k AS BIGINT) IS NULL, try_cast(k AS BIGINT), k) AS place FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS k FROM customer)")
def _(spark, d):
    k = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")).alias("k"))
    number = F.col("k").try_cast("bigint")
    coarse = [number.isNull(), F.coalesce(F.floor(number / 1024), F.lit(0)), F.when(number.isNull(), F.left("k", F.lit(15))).otherwise("")]
    return S.numbered(k, S.numeric_first(F.col("k")), coarse, "place")


@query("membership_filter", "SELECT doc_id, source FROM documents WHERE CAST(source AS VARCHAR) IN ('src1', 'src3')")
def _(spark, d):
    return S.member_filter(table(spark, d, "documents").select("doc_id", "source"), "source", ["src1", "src3"])


@query("tail_messages", "SELECT conv_id, turn, left(text, 40) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def _(spark, d):
    from millrace.operators.conversation import truncated_tail

    return truncated_tail(table(spark, d, "conversations"), "conv_id", "turn", 2, "text", 40).select("conv_id", "turn", "text")


@query("collapse_role_runs", "SELECT conv_id, turn, role FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) WHERE nx IS NULL OR nx <> role")
def _(spark, d):
    return S.collapse_runs(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@query("last_assistant_turn", "SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def _(spark, d):
    return table(spark, d, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))


@query("first_appearance", f"WITH {EV} SELECT event_type, min(event_id) AS first_at FROM ev GROUP BY event_type")
def _(spark, d):
    return S.first_appearance(events(spark, d), "event_type", "event_id")


@query("weighted_rotation", "WITH t AS (SELECT n_name, 1 + n_nationkey % 4 AS w, unnest(range(1, CAST(2 + n_nationkey % 4 AS BIGINT))) AS i FROM nation) SELECT row_number() OVER (ORDER BY (2 * i - 1) / (2 * w)::DOUBLE, n_name)::INTEGER AS slot, n_name FROM t")
def _(spark, d):
    return S.weighted_rotation(table(spark, d, "nation").select("n_name", (1 + F.col("n_nationkey") % 4).alias("w")), "n_name", "w")


@query("gold_left_join_fallback", "SELECT l.doc_id, coalesce(CAST(g.q AS VARCHAR), l.lang) AS gold FROM documents l LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) g USING (doc_id)")
def _(spark, d):
    gold = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("gold"))
    return J.left_fallback(table(spark, d, "documents").select("doc_id", "lang"), gold, ["doc_id"], "gold", ["lang"]).select("doc_id", "gold")


@query("composite_key_join", "SELECT l.l_orderkey, l.l_linenumber, p.n FROM lineitem l LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) p ON l.l_partkey = p.l_partkey AND l.l_suppkey = p.l_suppkey")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    n = li.filter("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return li.join(n, ["l_partkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", "n")


@query("verdict_precedence", "SELECT d.doc_id, coalesce(CASE WHEN d.n_chars % 3 = 0 THEN d.n_chars % 2 = 0 END, g.v) AS ok FROM documents d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS v FROM labels GROUP BY doc_id) g USING (doc_id)")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") % 3 == 0, F.col("n_chars") % 2 == 0).alias("ok"))
    return J.with_verdict(rows, table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("v")), ["doc_id"], "ok", "v")


@query("match_counts", "SELECT count(*) AS loaded, count(l.doc_id) AS matched, count(*) - count(l.doc_id) AS unmatched FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def _(spark, d):
    m = J.matched(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
    return m.agg(F.count("*").alias("loaded"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))


_RES = "r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'e' END AS error, quality + 1 AS attempt FROM labels)"


def _results(spark, d):
    return table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "e").alias("error"), (F.col("quality") + 1).alias("attempt"))


@query("done_semi", f"WITH {_RES} SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM r WHERE error IS NULL AND attempt >= 2)")
def _(spark, d):
    return J.done(table(spark, d, "documents").select("doc_id"), _results(spark, d), "doc_id", 2)


@query("pending_anti", f"WITH {_RES} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE error IS NULL AND attempt >= 2)")
def _(spark, d):
    return J.pending(table(spark, d, "documents").select("doc_id"), _results(spark, d), "doc_id", 2)


@query("set_xor", "SELECT s_nationkey AS k, 'left' AS side FROM (SELECT DISTINCT s_suppkey AS s_nationkey FROM supplier EXCEPT SELECT c_custkey * 2 FROM customer) UNION ALL SELECT k, 'right' FROM (SELECT c_custkey * 2 AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier)")
def _(spark, d):
    return J.set_changes(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("k")), "k")


@query("set_operations", "SELECT 'and' AS op, count(*) AS n FROM (SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'minus', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'or', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)")
def _(spark, d):
    t = lambda n, c: table(spark, d, n).select(F.col(c).cast("long").alias("k"))
    one = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    c, o = t("customer", "c_custkey"), t("orders", "o_custkey")
    return one(t("nation", "n_nationkey").intersect(t("supplier", "s_nationkey")), "and").unionAll(one(c.subtract(o), "minus")).unionAll(one(c.union(o).distinct(), "or"))


@query("missing_side_penalty", "SELECT c_custkey, coalesce(v, 1000.0)::DOUBLE AS v FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) USING (c_custkey)")
def _(spark, d):
    found = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    return J.with_penalty(table(spark, d, "customer").select("c_custkey"), found, ["c_custkey"], "v", 1000.0)


@query("referential_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def _(spark, d):
    return J.orphans(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, d, "part").filter("p_size > 5"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber")


@query("two_hop_join", "SELECT o.o_orderkey, coalesce(r.r_name, 'none') AS r_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def _(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").join(n, "n_nationkey", "left").join(table(spark, d, "region"), "r_regionkey", "left")
    return o.select("o_orderkey", F.coalesce("r_name", F.lit("none")).alias("r_name"))


@query("positional_zip_join", "WITH a AS (SELECT o_custkey AS k, o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS k, o_orderkey AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderkey % 2 = 1) SELECT k, x, y FROM a JOIN b USING (k, i, n)")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    a, b = o.filter("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "x"), o.filter("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "y")
    return J.zipped(a, b, ["k"], "x", "y").select("k", "x", "y")


@query("set_f1_pairs", "WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 25), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 20), n AS (SELECT (SELECT count(*) FROM a) AS n_truth, (SELECT count(*) FROM b) AS n_found, (SELECT count(*) FROM a JOIN b USING (l_partkey, l_suppkey)) AS n_both) SELECT *, 2.0::DOUBLE * n_both / (n_truth + n_found) AS f1 FROM n")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return M.set_f1(li.filter("l_quantity < 25"), li.filter("l_quantity >= 20"), ["l_partkey", "l_suppkey"])


@query("multi_valued_group", r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word")
def _(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


@query("upper_median", f"WITH {EV} SELECT event_type, list_sort(list(cents))[count(*) // 2 + 1] AS median_cents FROM ev GROUP BY event_type")
def _(spark, d):
    return M.order_statistics(events(spark, d), ["event_type"], "cents", {"median_cents": M.upper_median})


@query("nearest_rank_pct", f"WITH {EV} SELECT event_type, list_sort(list(cents))[CAST(floor(count(*) * 0.9::DOUBLE + 0.999) AS BIGINT)] AS p90, list_sort(list(cents))[CAST(floor(count(*) * 0.99::DOUBLE + 0.999) AS BIGINT)] AS p99 FROM ev GROUP BY event_type")
def _(spark, d):
    return M.order_statistics(events(spark, d), ["event_type"], "cents", {"p90": M.nearest_rank(0.9), "p99": M.nearest_rank(0.99)})


@query("mae_mape_rmse_penalty", "WITH e AS (SELECT CAST(l_quantity AS BIGINT) AS t, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) + (l_orderkey % 7) - 3 END AS f, l_returnflag FROM lineitem) SELECT l_returnflag, sum(abs(f - t)) / count(*)::DOUBLE AS mae, sqrt(sum((f - t) * (f - t)) / count(*)::DOUBLE) AS rmse FROM e GROUP BY l_returnflag")
def _(spark, d):
    e = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("t"), F.when(F.col("l_linenumber") % 5 == 0, F.lit(0)).otherwise(F.col("l_quantity").cast("long") + F.col("l_orderkey") % 7 - 3).alias("f"))
    return e.groupBy("l_returnflag").agg(*M.errors("t", "f")).drop("mape")


@query("mape_floored", "WITH e AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS t, CAST(l_quantity AS BIGINT) + (l_orderkey % 7) - 3 AS f FROM lineitem) SELECT l_orderkey, l_linenumber, abs(f - t) / greatest(5.0::DOUBLE, abs(t)) AS mape FROM e")
def _(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("t"), (F.col("l_quantity").cast("long") + F.col("l_orderkey") % 7 - 3).alias("f"))
    return e.select("l_orderkey", "l_linenumber", (F.abs(F.col("f") - F.col("t")) / F.greatest(F.lit(5.0), F.abs(F.col("t")))).alias("mape"))


@query("weighted_avg", "SELECT l_suppkey, CASE WHEN sum(w) = 0 THEN avg(q) ELSE sum(q * w)::DOUBLE / sum(w) END AS weighted FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_linenumber END AS w FROM lineitem) GROUP BY l_suppkey")
def _(spark, d):
    e = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q"), F.when(F.col("l_suppkey") % 9 == 0, 0).otherwise(F.col("l_linenumber")).alias("w"))
    return e.groupBy("l_suppkey").agg(M.weighted_mean("q", "w").alias("weighted"))


@query("class_balance_guard", "WITH p AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT min(n)::DOUBLE / sum(n) AS least_share, min(n)::DOUBLE / sum(n) >= 0.15 AND min(n) >= 5 AS balanced FROM p")
def _(spark, d):
    return M.label_share_guard(table(spark, d, "events"), "event_type", 0.15, 5)


@query("most_common_first_seen", f"WITH {EV}, p AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS a FROM ev GROUP BY ALL) SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, a) AS r FROM p) WHERE r = 1")
def _(spark, d):
    return M.most_common(events(spark, d), ["user_id"], "event_type", "event_id")


_LAB = "l AS (SELECT event_id, user_id, event_type AS t, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'view' ELSE event_type END AS f FROM events)"


def _labels(spark, d):
    f = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 4 == 0, "view").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("t"), f.alias("f"))


@query("class_counts", f"WITH {_LAB}, c AS (SELECT DISTINCT t AS label FROM l) SELECT label, CAST((SELECT count(*) FROM l WHERE t = label AND f = label) AS BIGINT) AS tp, CAST((SELECT count(*) FROM l WHERE f = label AND t <> label) AS BIGINT) AS fp, CAST((SELECT count(*) FROM l WHERE t = label AND f IS DISTINCT FROM label) AS BIGINT) AS fn FROM c")
def _(spark, d):
    return M.class_counts(_labels(spark, d), "t", "f")


@query("confusion_f1_macro", f"WITH {_LAB}, c AS (SELECT DISTINCT t AS label FROM l), k AS (SELECT label, (SELECT count(*) FROM l WHERE t = label AND f = label) AS tp, (SELECT count(*) FROM l WHERE f = label AND t <> label) AS fp, (SELECT count(*) FROM l WHERE t = label AND f IS DISTINCT FROM label) AS fn FROM c) SELECT avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) AS macro_f1, count(*) AS classes FROM k")
def _(spark, d):
    return M.macro_f1(M.class_counts(_labels(spark, d), "t", "f"))


@query("cohen_kappa", f"WITH {_LAB}, c AS (SELECT t, f, count(*) AS n FROM l WHERE f IS NOT NULL GROUP BY ALL), s AS (SELECT sum(n)::BIGINT AS n, sum(n) FILTER (WHERE t = f)::BIGINT AS same FROM c), r AS (SELECT t AS k, sum(n) AS x FROM c GROUP BY 1), q AS (SELECT f AS k, sum(n) AS y FROM c GROUP BY 1), e AS (SELECT sum(x * y)::BIGINT AS chance FROM r JOIN q USING (k)), z AS (SELECT n, same / n::DOUBLE AS observed, chance / (n * n)::DOUBLE AS expected FROM s, e) SELECT n, observed, expected, (observed - expected) / (1 - expected) AS kappa FROM z")
def _(spark, d):
    return M.cohen_kappa(_labels(spark, d), "t", "f")


@query("quadratic_kappa", "WITH l AS (SELECT CAST(user_id % 4 AS BIGINT) AS a, CAST((user_id + event_id % 2) % 4 AS BIGINT) AS b FROM events), s AS (SELECT count(*) AS n, sum((a - b) * (a - b))::BIGINT AS dis, sum(a)::BIGINT AS sx, sum(b)::BIGINT AS sy, sum(a * a)::BIGINT AS sxx, sum(b * b)::BIGINT AS syy FROM l) SELECT n, 1 - n * dis::DOUBLE / (n * (sxx + syy) - 2 * sx * sy) AS kappa FROM s")
def _(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("a"), ((F.col("user_id") + F.col("event_id") % 2) % 4).alias("b"))
    return M.quadratic_kappa(e, "a", "b")


@query("kendall_tau", "WITH p AS (SELECT a.o_custkey, sign(a.o_orderkey - b.o_orderkey)::INTEGER AS sa, sign(a.o_totalprice - b.o_totalprice)::INTEGER AS sb FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey) SELECT o_custkey, sum(sa * sb)::DOUBLE / nullif(sqrt(sum(abs(sa)) * sum(abs(sb))), 0) AS tau FROM p GROUP BY o_custkey")
def _(spark, d):
    return M.kendall_tau(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@query("claim_ratio", "SELECT l_orderkey, coalesce(sum(CASE WHEN l_quantity > 10 THEN l_linenumber ELSE 0 END) / sum(l_linenumber)::DOUBLE, 0) AS ratio, coalesce(bool_and(l_quantity > 10) FILTER (WHERE l_linenumber % 2 = 0), true) AS strict FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") > 10).alias("ok"), F.col("l_linenumber").alias("w"), F.when(F.col("l_linenumber") % 2 == 0, 1).alias("expected"))
    return M.claim_ratio(e, "l_orderkey", "ok", "w", "expected")


@query("severity_recall", "WITH r AS (SELECT user_id, max(CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) AS t, max(CASE WHEN event_id % 3 = 0 THEN 0 ELSE CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END END) AS f FROM events GROUP BY user_id) SELECT count(*) FILTER (WHERE t >= 1) AS positives, count(*) FILTER (WHERE t >= 1 AND f >= 1) / count(*) FILTER (WHERE t >= 1)::DOUBLE AS recall FROM r")
def _(spark, d):
    e = table(spark, d, "events").withColumn("found", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return M.severity_recall(e, "user_id", "event_type", "found", {"error": 2, "view": 1})


@query("dwell_share", f"WITH {EV} SELECT user_id, coalesce(sum(CASE WHEN event_type = 'view' THEN cents ELSE 0 END) / sum(cents)::DOUBLE, 0) AS dwell FROM ev WHERE cents >= 500 GROUP BY user_id")
def _(spark, d):
    return M.dwell_share(events(spark, d).withColumn("claimed", F.lit("view")), "user_id", "event_type", "cents", "claimed", 500)


@query("vocab_check", "SELECT count(*) AS rows, count(*) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) AS known, count(*) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) / count(*)::DOUBLE AS ratio FROM events")
def _(spark, d):
    return Q.vocabulary_share(table(spark, d, "events"), "event_type", spark.createDataFrame([("click",), ("view",), ("purchase",)], "v string"), "v")


@query("vocab_offenders", "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')")
def _(spark, d):
    return Q.offenders(table(spark, d, "events"), "event_type", spark.createDataFrame([("click",), ("view",), ("purchase",)], "v string"), "v")


@query("id_uniqueness", "SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS ids, count(*) = count(DISTINCT l_orderkey) AS \"unique\" FROM lineitem")
def _(spark, d):
    return Q.unique_ids(table(spark, d, "lineitem"), "l_orderkey")


@query("digest_check", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def _(spark, d):
    return Q.digests(table(spark, d, "documents"), "doc_id", "text")


@query("set_equality", "SELECT (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT DISTINCT s_nationkey FROM supplier)) AS missing, (SELECT count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier EXCEPT SELECT DISTINCT c_nationkey FROM customer)) AS extra, (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT DISTINCT s_nationkey FROM supplier)) = 0 AND (SELECT count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier EXCEPT SELECT DISTINCT c_nationkey FROM customer)) = 0 AS equal")
def _(spark, d):
    t = lambda n, c: table(spark, d, n).select(F.col(c).alias("k"))
    return Q.same_sets(t("customer", "c_nationkey"), t("supplier", "s_nationkey"), ["k"])


@query("at_most_one_per_group", "SELECT md5(text) AS g, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return Q.crowded_groups(table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("g")), "g")


@query("group_having_anti", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY o_custkey HAVING count(*) >= 2")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    return Q.repeated_without(o, o.filter("o_orderstatus = 'P'").select("o_custkey").distinct(), "o_custkey")


@query("range_constancy", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS \"values\" FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def _(spark, d):
    return Q.one_value(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus"))


@query("bounds_check", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_discount BETWEEN 0.02 AND 0.08)")
def _(spark, d):
    return Q.bounds(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", 0.02, 0.08).drop("l_discount")


@query("secret_scan", r"SELECT doc_id, ['text'] AS leaks FROM documents WHERE regexp_matches(text, '(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*\S+|\bsk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|/(home|Users)/[A-Za-z0-9._-]+/')")
def _(spark, d):
    return Q.secrets(table(spark, d, "documents").select("doc_id", "text"), ["text"]).select("doc_id", "leaks")


@query("validate_constraints", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 AND l_tax > 0.05 THEN 'quantity,tax' WHEN l_quantity > 40 THEN 'quantity' WHEN l_tax > 0.05 THEN 'tax' ELSE '' END AS broken FROM lineitem")
def _(spark, d):
    v = Q.validated(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), {"quantity": F.col("l_quantity") <= 40, "tax": F.col("l_tax") <= 0.05})
    return v.select("l_orderkey", "l_linenumber", F.array_join("broken", ",").alias("broken"))


_TRAJ = "t AS (SELECT o_custkey AS g, o_orderkey AS id, CAST(o_orderkey % 5 AS DOUBLE) / 4 AS reward, o_orderkey % 13 = 0 AS removed, CAST(1 + o_orderkey % 9 AS BIGINT) AS num_steps FROM orders)"


def _trajectories(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("g"), k.alias("id"), ((k % 5).cast("double") / 4).alias("reward"), (k % 13 == 0).alias("removed"), (1 + k % 9).alias("num_steps"))


@query("reward_group_center", f"WITH {_TRAJ} SELECT g, id, CASE WHEN removed THEN 0.0::DOUBLE ELSE reward - avg(CASE WHEN NOT removed THEN reward END) OVER (PARTITION BY g) END AS advantage FROM t")
def _(spark, d):
    return W.centred(_trajectories(spark, d), "g").select("g", "id", "advantage")


@query("zero_std_filter", f"WITH {_TRAJ}, a AS (SELECT g, count(*) FILTER (WHERE removed) AS o, count(*) FILTER (WHERE NOT removed) AS n, max(reward) - min(reward) <= 1e-8 AS flat FROM t GROUP BY g) SELECT g, o = 0 AND n > 1 AND NOT flat AS keep, CASE WHEN o > 0 THEN 'removed' WHEN n <= 1 THEN 'active' WHEN flat THEN 'zero' END AS why FROM a")
def _(spark, d):
    return W.group_filter(_trajectories(spark, d), "g").select("g", "keep", F.substring_index("reason", "_", 1).alias("why"))


@query("length_factor", f"WITH {_TRAJ}, m AS (SELECT *, min(CASE WHEN NOT removed AND reward >= 1 THEN num_steps END) OVER (PARTITION BY g) AS best FROM t) SELECT g, id, CASE WHEN NOT removed AND reward >= 1 AND best IS NOT NULL THEN greatest(0.5, 1 - 0.2 * (num_steps - best)::DOUBLE / best) ELSE 1.0 END::DOUBLE AS length_factor, best IS NOT NULL AS has_reference FROM m")
def _(spark, d):
    t = _trajectories(spark, d).withColumns({"score": F.col("reward"), "correctness": F.floor("reward").cast("double"), "modality_match": F.lit(True), "n_tool": F.lit(1)})
    return W.length_shaped(t, "g").select("g", "id", "length_factor", "has_reference")


@query("dim_weighted_score", """WITH dims AS (SELECT * FROM (VALUES ('a', 0.5, 30.0, true), ('b', 0.25, 0.05, false), ('c', 0.25, 2.0, true)) v(dim, weight, threshold, higher)),
v AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'a' AS dim, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'b', l_discount FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'c', CAST(l_linenumber AS DOUBLE) FROM lineitem)
SELECT id, bool_and(CASE WHEN higher THEN value >= threshold ELSE value <= threshold END) AND count(*) = 3 AS passed FROM v JOIN dims USING (dim) GROUP BY id""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    dims = spark.createDataFrame([("a", 0.5, 30.0, True), ("b", 0.25, 0.05, False), ("c", 0.25, 2.0, True)], "dim string, weight double, threshold double, higher boolean")
    pairs = F.array(F.struct(F.lit("a").alias("dim"), F.col("l_quantity").alias("value")), F.struct(F.lit("b").alias("dim"), F.col("l_discount").alias("value")), F.struct(F.lit("c").alias("dim"), F.col("l_linenumber").cast("double").alias("value")))
    v = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.explode(pairs).alias("x")).select("id", "x.*")
    return R.weighted_score(v, dims, "id").select("id", "passed")


@query("rescore_transitions", f"WITH {_LAB}, x AS (SELECT t, f, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 5 = 0 THEN t ELSE f END AS n FROM l) SELECT count(*) AS total, count(*) FILTER (WHERE n IS NULL) AS skipped, count(*) FILTER (WHERE n IS NOT NULL AND n IS DISTINCT FROM f) AS flipped, count(*) FILTER (WHERE n IS NOT NULL AND f IS DISTINCT FROM t AND n = t) AS recovered, count(*) FILTER (WHERE n IS NOT NULL AND f = t AND n <> t) AS regressed FROM x")
def _(spark, d):
    x = _labels(spark, d).withColumn("n", F.when(F.col("event_id") % 6 == 0, None).when(F.col("event_id") % 5 == 0, F.col("t")).otherwise(F.col("f")))
    return R.transitions(x, F.col("f"), F.col("n"), F.col("f") == F.col("t"), F.col("n") == F.col("t"))


@query("filter_summary", f"WITH {_LAB} SELECT coalesce(nullif(CASE WHEN user_id % 4 = 0 THEN '' ELSE t END, ''), '?') AS kind, count(*) AS total, count(*) FILTER (WHERE f = t) AS passed FROM l GROUP BY 1")
def _(spark, d):
    x = _labels(spark, d).select(F.when(F.col("user_id") % 4 == 0, "").otherwise(F.col("t")).alias("k"), (F.col("f") == F.col("t")).alias("ok"))
    return R.filter_summary(x, "k", "ok")


@query("trajectory_inventory", """WITH c AS (SELECT o_orderstatus AS benchmark, CAST(o_custkey AS VARCHAR) AS item_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 <> 0 END AS correct, o_orderkey % 4 <> 0 AS complete FROM orders),
s AS (SELECT DISTINCT benchmark, item_id FROM c WHERE correct AND complete), r AS (SELECT DISTINCT benchmark, item_id FROM c WHERE correct)
SELECT c.benchmark, count(*) AS candidate_rows, count(DISTINCT item_id) AS unique_items, count(*) FILTER (WHERE correct) AS correct_candidate_rows, count(*) FILTER (WHERE correct IS NULL) AS unscored_candidate_rows,
(SELECT count(*) FROM r WHERE r.benchmark = c.benchmark) AS correct_unique_items, (SELECT count(*) FROM s WHERE s.benchmark = c.benchmark) AS selected,
(SELECT count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM s) m WHERE m.benchmark = c.benchmark) AS missing FROM c GROUP BY c.benchmark""")
def _(spark, d):
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(F.col("o_orderstatus").alias("benchmark"), F.col("o_custkey").cast("string").alias("item_id"), F.when(k % 5 != 0, k % 3 != 0).alias("correct"), (k % 4 != 0).alias("complete"), k.alias("attempt"))
    return R.inventory(c, [F.desc("attempt")])[1].drop("missing_ids")


@query("grade_rollup", "SELECT count(*) AS total, count(p) AS graded, count(*) FILTER (WHERE p) AS passed, count(*) FILTER (WHERE NOT p) AS failed, count(*) FILTER (WHERE toxic = 1) AS errors, sum(quality) / count(quality)::DOUBLE AS mean_score FROM (SELECT *, CASE WHEN toxic = 0 THEN quality = 1 END AS p FROM labels)")
def _(spark, d):
    g = table(spark, d, "labels").select(F.when(F.col("toxic") == 0, F.col("quality") == 1).alias("passed"), F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"), F.col("quality").alias("score"))
    return R.grade_rollup(g)


@query("failures_latest", f"WITH {_LAB}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7 DESC, event_id DESC) AS r FROM l) SELECT user_id FROM x WHERE r = 1 AND (f IS NULL OR f <> t)")
def _(spark, d):
    x = S.latest_per_key(_labels(spark, d).withColumn("attempt", F.col("event_id") % 7), ["user_id"], "attempt", "event_id")
    return R.failures(x.withColumn("ok", F.col("f") == F.col("t")).withColumn("error", F.when(F.col("f").isNull(), "none")), "user_id", "ok", "error")


@query("dispatcher_snapshot", f"WITH {EV} SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'error') AS n_errors, list_sort(list(cents))[count(*) // 2 + 1] AS median_elapsed, list_sort(list(cents % 9))[count(*) // 2 + 1] AS median_tools FROM ev")
def _(spark, d):
    return R.snapshot(events(spark, d).select("cents", (F.col("cents") % 9).alias("tools"), F.when(F.col("event_type") == "error", "e").alias("error")), "cents", "tools", "error")
