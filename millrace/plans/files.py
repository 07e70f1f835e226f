"""Queries that read real files: table rows are written as files of a format, and read by the library's scans, data sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import graders as G
from millrace.operators.stepwise import Steps
from millrace.plans.base import EV, events, query, table
from millrace.sources import formats, scan, sink
from millrace.streaming import replay as R


def _text(rows, steps, name: str, by: str | None = None, **options) -> str:
    """Rows of one text column as files below a folder."""
    w = rows.write.options(**options)
    (w.partitionBy(by) if by else w).text(f"{steps.root}/{name}")
    return f"{steps.root}/{name}"


def _gauge_lines(spark, d):
    """Samples without a rank, of ranks 0 and 1, broken samples, and comments."""
    k = F.col("event_id") % 5
    rank = F.when(k == 1, F.lit(',tp_rank="0"')).when(k == 2, F.lit(',tp_rank="1"')).otherwise("")
    sample = F.concat(F.lit("queue:"), "event_type", F.lit('{user="a \\"'), F.col("user_id").cast("string"), F.lit('"'), rank, F.lit("}"))
    text = F.when(k == 3, F.concat(F.lit("# TYPE queue:"), "event_type", F.lit(" gauge"))).when(k == 4, F.concat(sample, F.lit(" many"))).otherwise(F.concat(sample, F.lit(" "), (F.col("cents") / 4).cast("string")))
    return events(spark, d).select(text.alias("value"))


_GAUGE = "SELECT 'queue:' || event_type AS metric, 'a \\\"' || user_id AS \"user\", CASE event_id % 5 WHEN 1 THEN '0' WHEN 2 THEN '1' END AS rank, cents / 4.0::DOUBLE AS value, NULL::VARCHAR AS bad FROM ev WHERE event_id % 5 < 3"


@query("prometheus_source", f"WITH {EV} {_GAUGE} UNION ALL SELECT NULL, NULL, NULL, NULL, 'queue:' || event_type || '{{user=\"a \\\"' || user_id || '\"}} many' FROM ev WHERE event_id % 5 = 4")
def _(spark, d):
    formats.register(spark)
    path = _text(_gauge_lines(spark, d), Steps(spark, "gauges"), "in")
    got = spark.read.format("prometheus_text").load(path)
    return got.select("metric", F.col("labels")["user"].alias("user"), F.col("labels")["tp_rank"].alias("rank"), "value", "bad")


@query("gauge_stream", f"WITH {EV}, g AS ({_GAUGE}) SELECT metric, sum(value) AS total, max(value) AS most FROM g WHERE coalesce(rank, '0') = '0' GROUP BY metric")
def _(spark, d):
    """Snapshots as they come to a folder, folded over all that are there."""
    formats.register(spark)
    steps = Steps(spark, "gauge-stream")
    path = _text(_gauge_lines(spark, d).repartition(6), steps, "in")
    got = spark.readStream.format("prometheus_text").load(path)
    rank0 = got.filter("bad is null").filter(F.coalesce(F.col("labels")["tp_rank"], F.lit("0")) == "0")
    return R.finished(rank0.groupBy("metric").agg(F.sum("value").alias("total"), F.max("value").alias("most")), "complete", steps)


@query("subtitle_source", r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM conversations)
SELECT turn * 60 + 0.5::DOUBLE AS start, turn * 60 + 3.25::DOUBLE AS "end", x AS text, NULL::VARCHAR AS bad FROM t WHERE conv_id % 5 > 0 UNION ALL SELECT NULL, NULL, NULL, CAST(turn AS VARCHAR) || chr(10) || x FROM t WHERE conv_id % 5 = 0""")
def _(spark, d):
    """Blocks of all turns, some without their line of times."""
    formats.register(spark)
    clock = lambda s: F.concat(F.lpad(F.floor(F.col("turn") / 60), 2, "0"), F.lit(":"), F.lpad(F.col("turn") % 60, 2, "0"), F.lit(":" + s))
    times = F.when(F.col("conv_id") % 5 > 0, F.concat(clock("00,500"), F.lit(" --> "), clock("03.250"), F.lit("\r\n"))).otherwise("")
    block = F.concat(F.col("turn"), F.lit("\r\n"), times, F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("\r\n"))
    path = _text(table(spark, d, "conversations").select(block.alias("value")), Steps(spark, "subtitles"), "in")
    return spark.read.format("subtitles_srt").load(path).select("start", "end", "text", "bad")


def _agent_lines(spark, d):
    """Turns as JSON objects; those of users as plain lines, and some as a JSON list."""
    c = table(spark, d, "conversations")
    line = F.when(F.col("role") == "user", F.concat(F.lit("user "), F.col("conv_id"))).when(F.col("turn") % 4 == 3, F.concat(F.lit("["), F.col("turn"), F.lit("]"))).otherwise(F.to_json(F.struct("conv_id", "turn", "role", "text")))
    return c.select((F.col("conv_id") % 8).alias("b"), "conv_id", "turn", line.alias("value"))


_AGENT = "WITH t AS (SELECT conv_id, turn, conv_id % 8 AS b, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) AS line, CASE WHEN role = 'user' THEN 'user ' || conv_id WHEN turn % 4 = 3 THEN '[' || turn || ']' END AS bad FROM conversations) "


@query("agent_events_source", _AGENT + "SELECT CASE WHEN bad IS NULL THEN conv_id END AS conv_id, CASE WHEN bad IS NULL THEN turn END AS turn, bad FROM t")
def _(spark, d):
    formats.register(spark)
    path = _text(_agent_lines(spark, d).select("value"), Steps(spark, "agent"), "in")
    got = spark.read.format("agent_events").load(path)
    return got.select(F.get_json_object("event", "$.conv_id").cast("long").alias("conv_id"), F.get_json_object("event", "$.turn").cast("long").alias("turn"), "bad")


@query("event_log_scan", _AGENT + "SELECT b, line, conv_id, turn FROM t WHERE bad IS NULL")
def _(spark, d):
    """Events with the number of their line in their file."""
    rows = _agent_lines(spark, d).repartition("b").sortWithinPartitions("b", "conv_id", "turn").select("b", "value")
    path = _text(rows, Steps(spark, "log"), "in", "b")
    got = scan.event_log(spark, path)
    return got.select(F.regexp_extract("path", r"/b=(\d+)/", 1).cast("long").alias("b"), F.col("line").cast("long").alias("line"), F.get_json_object("event", "$.conv_id").cast("long").alias("conv_id"), F.get_json_object("event", "$.turn").cast("long").alias("turn"))


@query("tolerant_lines_scan", "SELECT CASE WHEN turn % 4 = 3 THEN NULL ELSE role END AS role, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY ALL")
def _(spark, d):
    got = scan.json_lines(spark, _text(_agent_lines(spark, d).select("value"), Steps(spark, "tolerant"), "in"))
    return got.groupBy(F.get_json_object("text", "$.role").alias("role")).agg(F.count("*").alias("n"))


@query("strict_lines_scan", f"WITH {EV} SELECT event_id, user_id, event_type, cents FROM ev")
def _(spark, d):
    path = _text(events(spark, d).select(F.to_json(F.struct("event_id", "user_id", "event_type", "cents")).alias("value")), Steps(spark, "strict"), "in", compression="gzip")
    return scan.strict_json_lines(spark, path, "event_id long, user_id long, event_type string, cents long", "event_id")


@query("canonical_csv_scan", "SELECT CAST(c_custkey AS VARCHAR) AS cust_key, c_mktsegment AS market_segment_2, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def _(spark, d):
    root = f"{Steps(spark, 'csv').root}/in"
    table(spark, d, "customer").select(F.col("c_custkey").alias(" Cust-Key"), F.col("c_mktsegment").alias("Market  Segment (2)"), F.col("c_nationkey").alias("NATION!")).write.option("header", "true").csv(root)
    return scan.canonical_csv(spark, root, ["cust_key", "nation"])


@query("checked_shards", "SELECT o_custkey % 9 AS shard, CASE WHEN o_custkey % 9 > 5 THEN -1 ELSE count(*) END AS rows FROM orders GROUP BY o_custkey % 9")
def _(spark, d):
    """Shards of JSON lines, some compressed, some with one line cut off, and one of Parquet: bad ones are told and the rest is read."""
    formats.register(spark)
    steps = Steps(spark, "shards")
    o = table(spark, d, "orders").select((F.col("o_custkey") % 9).alias("shard"), "o_orderkey", "o_totalprice")
    line = F.to_json(F.struct("o_orderkey", "o_totalprice"))
    last = F.max("o_orderkey").over(Window.partitionBy("shard"))
    cut = F.when((F.col("shard") > 5) & (F.col("o_orderkey") == last), F.substring(line, 1, 12)).otherwise(line)
    lines = o.filter("shard > 0").select("shard", cut.alias("value")).repartition("shard")
    path = _text(lines.filter("shard % 2 = 0"), steps, "in", "shard")
    lines.filter("shard % 2 = 1").write.mode("append").partitionBy("shard").option("compression", "gzip").text(path)
    o.filter("shard = 0").drop("shard").coalesce(1).write.parquet(f"{path}/shard=0")
    got = spark.read.format("checked_shards").schema("o_orderkey long, o_totalprice double, path string, error string").load(path)
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard")
    return got.groupBy(shard).agg(F.when(F.count("error") > 0, -1).otherwise(F.count("o_orderkey")).alias("rows"))


@query("sink_round_trip", "SELECT l_returnflag, l_linestatus, count(*) AS parquet_rows, count(*) AS json_rows, sum(l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY ALL")
def _(spark, d):
    root = Steps(spark, "sinks").root
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    sink.parquet(li, f"{root}/parquet", ["l_returnflag"])
    sink.json_lines(li, f"{root}/json")
    by = ["l_returnflag", "l_linestatus"]
    a = spark.read.parquet(f"{root}/parquet").groupBy(*by).agg(F.count("*").alias("parquet_rows"))
    b = spark.read.schema(li.schema).json(f"{root}/json").groupBy(*by).agg(F.count("*").alias("json_rows"), F.sum("l_linenumber").cast("long").alias("numbers"))
    return a.join(b, by)


@query("dataset_manifest", "SELECT count(*) AS rows, true AS same FROM part")
def _(spark, d):
    """A dataset's manifest, and whether what is read back has the same digest."""
    root, p = Steps(spark, "dataset").root, table(spark, d, "part")
    made = sink.dataset(p, f"{root}/a", "p_partkey")
    again = sink.dataset(spark.read.schema(p.schema).json(f"{root}/a"), f"{root}/b", "p_partkey")
    return made.crossJoin(again.select(F.col("sha256").alias("other"))).select("rows", (F.col("sha256") == F.col("other")).alias("same"))  # a row each


_CLAIMS = """WITH p AS (SELECT DISTINCT c_nationkey AS k, l_partkey AS a, l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
m AS (SELECT k, a, b, (a + b) % 7 = 0 AND a % 5 <> 0 AS odd FROM p WHERE (a * 3 + b) % 10 < CASE WHEN k % 2 = 0 THEN 8 ELSE 7 END UNION SELECT k, a, b + 100000, false FROM p WHERE a % 23 = 0),
u AS (SELECT DISTINCT k, CASE WHEN k = 4 THEN 'C' ELSE 'A' END AS v, a FROM p WHERE k % 3 = 1 AND a % 11 = 0 AND (k = 4 OR NOT EXISTS (SELECT 1 FROM m WHERE m.k = p.k AND m.a = p.a)))"""


@query("catalog_grader", _CLAIMS + """, t AS (SELECT p.k, count(*) AS n, count(*) FILTER ((p.a + p.b) % 7 = 0) AS odd, count(m.a) AS hit, count(m.a) FILTER (m.odd AND (p.a + p.b) % 7 = 0) AS odd_hit FROM p LEFT JOIN m USING (k, a, b) GROUP BY p.k),
f AS (SELECT k, count(*) AS n FROM m GROUP BY k),
s AS (SELECT t.k, t.hit / t.n::DOUBLE AS r, t.hit / f.n::DOUBLE AS p, t.odd_hit / greatest(t.odd, 1)::DOUBLE AS q, ((t.k % 4 > 0)::INT + (t.k % 3 > 0)::INT + 2) / 4.0::DOUBLE AS x, t.k % 6 <> 5 AS chart, t.k <> 4 AND 100 + t.k * 12 <= 320 AS fits FROM t JOIN f USING (k))
SELECT k AS task, 0.18 * r + 0.18 * p + 0.22 * q + 0.07 * chart::INT + 0.20 * fits::INT + 0.15 * x AS score, r >= 0.75 AND p >= 0.8 AND q >= 0.7 AND x >= 0.7 AND chart AND fits AS passed FROM s""")
def _(spark, d):
    """A case of each nation: the parts and suppliers that its customers met, and claims about them."""
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    p = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("k"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    a, b, k = F.col("a"), F.col("b"), F.col("k")
    odd = (a + b) % 7 == 0
    m = p.filter((a * 3 + b) % 10 < F.when(k % 2 == 0, 8).otherwise(7)).select("k", "a", "b", (odd & (a % 5 != 0)).alias("flag")).unionAll(p.filter(a % 23 == 0).select("k", "a", (b + 100_000).alias("b"), F.lit(False).alias("flag")))
    rest = p.filter((k % 3 == 1) & (a % 11 == 0))
    rest = rest.filter("k = 4").unionAll(rest.filter("k <> 4").join(m.select("k", "a"), ["k", "a"], "left_anti").select("k", "a", "b"))
    row = lambda df, kind, x, y, flag, n=None: df.select(k.alias("task"), F.lit(kind).alias("kind"), x.alias("a"), y.alias("b"), flag.alias("flag"), F.lit(n).cast("int").alias("n") if n is None else n.cast("int").alias("n"))
    sku, none = lambda v, x: F.concat(F.lit(f"{v}-"), x.cast("string")), F.lit(None)
    cases = p.select("k").distinct()
    axes = cases.select("k", F.explode(F.array(k % 4 > 0, k % 3 > 0, F.lit(True), F.lit(True))).alias("flag"))
    rows = row(p, "truth", sku("A", a), sku("B", b), odd).unionAll(row(m, "match", sku("A", a), sku("B", b), F.col("flag")))
    rows = rows.unionAll(row(rest, "unmatched", F.when(k == 4, "C").otherwise("A"), sku("A", a), none.cast("boolean"))).unionAll(row(axes, "axis", none.cast("string"), none.cast("string"), F.col("flag")))
    rows = rows.unionAll(row(cases, "report", none.cast("string"), none.cast("string"), none.cast("boolean"), 100 + k * 12)).unionAll(row(cases, "chart", F.when(k % 6 == 5, "640").otherwise("1280"), F.lit("720"), none.cast("boolean")))
    dims = G.graded(rows, G.Reconciliation, "task")
    return G.weighed(dims, "task", G.Reconciliation.WEIGHTS, G.Reconciliation.FLAGS)
