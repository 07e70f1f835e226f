"""Queries for scans and sinks: files are made of table rows, a file to a customer, an order or a part, and read as files are."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import quality as Q
from millrace.sources import scan, sink
from millrace.plans.base import EV, events, query, table


def _line_files(spark, d):
    """A file of each order: its lines as JSON objects, wrapped in one of five ways; a number among them is no object."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q")).alias("x"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # of one order
    listed = F.regexp_replace(F.to_json("xs"), r"^\[", "[7,")
    k = F.col("l_orderkey") % 5
    wrap = lambda name: F.concat(F.lit('{"note": 1, "' + name + '": '), listed, F.lit("}"))
    content = F.when(k == 0, listed).when(k == 1, wrap("data")).when(k == 2, wrap("items")).when(k == 3, wrap("results")).otherwise(wrap("questions"))
    return g.select(F.concat(F.lit("/runs/"), "l_orderkey", F.lit("/a.json")).alias("path"), content.alias("content"))


@query("json_items_scan", "SELECT '/runs/' || l_orderkey || '/a.json' AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS place, l_linenumber::BIGINT AS n FROM lineitem")
def _(spark, d):
    return scan.json_items(_line_files(spark, d)).select("path", F.col("place").cast("long").alias("place"), F.get_json_object("item", "$.n").cast("long").alias("n"))


@query("json_any_scan", "SELECT '/runs/' || o_custkey || '/log.jsonl' AS path, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_custkey UNION ALL SELECT '/runs/' || n_nationkey || '/n.json', 1, n_nationkey FROM nation")
def _(spark, d):
    """Files of JSON lines with blank lines between, beside files of JSON."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.to_json(F.struct("o_orderkey"))), "\n \n").alias("content"))  # of one customer
    log = o.select(F.concat(F.lit("/runs/"), "o_custkey", F.lit("/log.jsonl")).alias("path"), "content")
    plain = table(spark, d, "nation").select(F.concat(F.lit("/runs/"), "n_nationkey", F.lit("/n.json")).alias("path"), F.to_json(F.struct(F.array(F.struct(F.col("n_nationkey").alias("o_orderkey"))).alias("items"))).alias("content"))
    key = F.get_json_object("item", "$.o_orderkey").cast("long")
    return scan.json_any(log.unionAll(plain)).groupBy("path").agg(F.count("*").alias("rows"), F.sum(key).alias("keys"))


@query("id_map_scan", "WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey % 3 = 0 AS named, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m, l_linenumber, l_orderkey FROM lineitem) SELECT DISTINCT CASE WHEN named THEN 'q' || k ELSE 'r' || l_orderkey END AS id, CASE WHEN named THEN l_linenumber ELSE m END::BIGINT AS n FROM l")
def _(spark, d):
    """Maps by id, and lists in which an id repeats: the last holds."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    n, one = F.col("l_linenumber"), F.col("l_orderkey") % 3 == 0
    key = F.concat(F.lit("q"), F.col("l_orderkey") * 10 + n)
    maps = li.filter(one).groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.struct(n.alias("n")))))).alias("content"))  # of one order
    lists = li.filter(~one).groupBy("l_orderkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: F.struct(F.concat(F.lit("r"), F.first("l_orderkey")).alias("question_id"), x.alias("n")))).alias("content"))
    files = maps.unionAll(lists).select("content")
    return scan.id_map(files).select("id", F.get_json_object("record", "$.n").cast("long").alias("n"))


@query("grade_scan", "SELECT CAST(c_custkey AS VARCHAR) AS task, CASE c_custkey % 4 WHEN 0 THEN c_acctbal > 0 WHEN 1 THEN NULL END AS passed, CASE WHEN c_custkey % 4 < 2 THEN c_nationkey / 10.0 END::DOUBLE AS score, CASE c_custkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' END AS status FROM customer")
def _(spark, d):
    """Grades: whole, so far, unreadable, and none."""
    c = table(spark, d, "customer")
    k, score = F.col("c_custkey") % 4, F.format_string("%.1f", F.col("c_nationkey") / 10)
    content = F.when(k == 0, F.concat(F.lit('{"pass": '), (F.col("c_acctbal") > 0).cast("string"), F.lit(', "score": '), score, F.lit("}"))).when(k == 1, F.concat(F.lit('{"score_so_far": '), score, F.lit(', "status": "error"}'))).otherwise(F.lit('{"pass": tr'))
    files = c.filter(k < 3).select(F.concat(F.lit("/out/"), "c_custkey", F.lit("/grade.json")).alias("path"), content.alias("content"))
    return scan.grades(c.select(F.col("c_custkey").cast("string").alias("task")), files)


@query("newest_folder", "SELECT o_custkey, max_by(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, d):
    return scan.newest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderkey", "o_orderdate")


@query("prometheus_scan", f"WITH {EV} SELECT 'queue:' || event_type AS metric, CAST(user_id AS VARCHAR) AS \"user\", cents / 4.0::DOUBLE AS value FROM ev WHERE event_id % 4 < 2")
def _(spark, d):
    """Samples of rank 0, samples without a rank, those of other ranks, and comments."""
    k = F.col("event_id") % 4
    rank = F.when(k == 1, F.lit(',tp_rank="0"')).when(k == 2, F.lit(',tp_rank="1"')).otherwise("")
    text = F.when(k == 3, F.concat(F.lit("# TYPE queue:"), "event_type", F.lit(" gauge"))).otherwise(F.concat(F.lit("queue:"), "event_type", F.lit('{user="'), F.col("user_id").cast("string"), F.lit('"'), rank, F.lit("} "), (F.col("cents") / 4).cast("string")))
    return scan.prometheus(events(spark, d).select(text.alias("value"))).select("metric", F.col("labels")["user"].alias("user"), "value")


@query("subtitle_scan", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, turn * 60 + 0.5::DOUBLE AS start, turn * 60 + 3.25::DOUBLE AS \"end\", trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations")
def _(spark, d):
    """A subtitle file of each conversation, a block to a turn, behind a block without a time."""
    clock = lambda s: F.concat(F.lpad(F.floor(F.col("turn") / 60), 2, "0"), F.lit(":"), F.lpad(F.col("turn") % 60, 2, "0"), F.lit(":" + s))
    block = F.concat(F.col("turn"), F.lit("\r\n"), clock("00,500"), F.lit(" --> "), clock("03,250"), F.lit("\r\n"), F.trim(F.regexp_replace("text", r"\s+", " ")))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\r\n\r\n").alias("b"))  # of one conversation
    files = c.select(F.col("conv_id").alias("path"), F.concat(F.lit("no time here\r\n\r\n"), "b").alias("content"))
    return scan.subtitles(files).select(F.col("path").alias("conv_id"), F.col("place").cast("long").alias("place"), "start", "end", "text")


@query("result_payloads", "SELECT '/runs/' || l_orderkey || '/a.json' AS path, CASE WHEN l_orderkey % 5 IN (0, 3) THEN count(*) ELSE -1 END AS rows FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    """A list, or an object with results, is a payload; files of other shapes are told apart."""
    good, bad = scan.normalized_results(_line_files(spark, d))
    return good.groupBy("path").agg(F.count("*").alias("rows")).unionAll(bad.select("path", F.lit(-1).cast("long").alias("rows")))


@query("artifact_scan", "SELECT p_partkey, p_partkey % 3 <> 2 AS filled, p_partkey % 3 = 0 AS parses FROM part")
def _(spark, d):
    content = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.struct("p_name"))).when(F.col("p_partkey") % 3 == 1, F.lit("{not json")).otherwise("x")
    files = table(spark, d, "part").select(F.col("p_partkey").alias("path"), content.alias("content")).withColumn("length", F.octet_length("content"))
    return scan.artifacts(files).withColumnRenamed("path", "p_partkey")


@query("prompt_rows", """SELECT p_name || chr(10) || '  A. ' || p_brand || chr(10) || '  B. ' || p_type AS prompt, '["' || p_brand || '"]' AS label, '{"task_id":"' || CASE WHEN p_size % 2 = 0 THEN 'fixture' ELSE p_brand END || ':' || p_partkey || '","answer_type":"mcq"}' AS metadata FROM part""")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.lit("mcq").alias("answer_type"), F.array("p_brand").alias("ground_truth"), F.array("p_brand", "p_type").alias("options"), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")).alias("source"))
    return sink.prompt_rows(p)


@query("image_payloads", "SELECT page_id, CASE page_id % 3 WHEN 2 THEN NULL ELSE strlen(html) END::DOUBLE AS bytes, CASE page_id % 3 WHEN 2 THEN NULL ELSE sha256(html) END AS sha256 FROM pages")
def _(spark, d):
    """Base64 with a data header, without one, and text that is no base64."""
    coded = F.base64(F.col("html").cast("binary"))
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("data:image/png;base64,"), coded)).when(F.col("page_id") % 3 == 1, coded).otherwise("~~no base64~~")
    return sink.decoded(table(spark, d, "pages").select("page_id", text.alias("t")), "t").select("page_id", F.octet_length("bytes").cast("double").alias("bytes"), F.sha2("bytes", 256).alias("sha256"))


@query("disjoint_sets", "SELECT count(*) = 0 AS disjoint FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM labels WHERE doc_id % 2 = 1) UNION ALL SELECT count(*) = 0 FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def _(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return Q.disjoint(docs.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1"), "doc_id").unionAll(Q.disjoint(docs, labels, "doc_id"))
