"""Readers. Listings are Spark's; content is parsed in columns, with the place of each row kept."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WRAPPERS = ("data", "items", "results", "questions")


def whole_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length, modified, content (text) of every file below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("content"))


def visible(df: DataFrame, path: str = "path") -> DataFrame:
    """Without files in dot folders."""
    return df.filter(~F.col(path).rlike(r"/\.[^/]"))


def json_items(files: DataFrame, wrappers: Sequence[str] = WRAPPERS, strict: bool = True) -> DataFrame:
    """(path, place, item) of JSON files that hold a list, or an object with a list under one of the wrapper names; item is JSON text. Entries that are no objects are dropped after places are given. A file of another shape raises, or gives no rows if not strict."""
    content = F.col("content")
    listed = lambda c: F.from_json(c, "array<string>")
    named = F.coalesce(*(F.get_json_object(content, f"$.{w}") for w in wrappers))
    body = F.when(F.trim(content).startswith("["), content).otherwise(named)
    if strict:
        body = F.coalesce(body, F.raise_error(F.concat(F.lit("no list in "), F.col("path"))).cast("string"))
    out = files.select("path", F.posexplode(listed(body)).alias("place", "item"))
    return out.filter(F.trim(F.col("item")).startswith("{"))


def json_any(files: DataFrame, wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """(path, place, item) of JSON files and, by the suffix .jsonl, files of JSON lines, whose blank lines are skipped. An empty file, or a line that is no object, raises."""
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    files = files.withColumn("content", F.when(blank, F.raise_error(F.concat(F.lit("empty file "), F.col("path"))).cast("string")).otherwise(F.col("content")))
    cut = F.filter(F.split("content", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = files.filter(F.lower("path").endswith(".jsonl")).select("path", F.posexplode(cut).alias("place", "item"))
    good = F.trim("item").startswith("{") & F.try_parse_json("item").isNotNull()
    rows = rows.withColumn("item", F.when(F.coalesce(good, F.lit(False)), F.col("item")).otherwise(F.raise_error(F.concat(F.lit("bad line in "), F.col("path"))).cast("string")))
    return json_items(files.filter(~F.lower("path").endswith(".jsonl")), wrappers).unionAll(rows)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) with line numbers from 1 in each file. Files are read whole, as line numbers need."""
    cut = F.split(F.regexp_replace("content", r"\r?\n$", ""), r"\r?\n")
    return whole_files(spark, path).select("path", F.posexplode(cut).alias("line", "text")).withColumn("line", F.col("line") + 1)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) of lines that are JSON; blank and other lines are skipped."""
    return spark.read.text(path).filter(F.try_parse_json("value").isNotNull()).select(F.col("value").alias("text"))


def strict_json_lines(spark: SparkSession, path: str, schema: str, unique: str | None = None) -> DataFrame:
    """Typed rows of JSON lines; a bad line or a repeated id raises."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if unique:
        n = F.count("*").over(Window.partitionBy(unique))
        df = df.withColumn("_n", n).withColumn(unique, F.when(F.col("_n") == 1, F.col(unique)).otherwise(F.raise_error(F.concat(F.lit("repeated id "), F.col(unique).cast("string"))).cast(df.schema[unique].dataType))).drop("_n")
    return df


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an agent's log that are JSON objects: (path, line, event)."""
    df = lines(spark, path).filter(F.col("text").startswith("{") & F.try_parse_json("text").isNotNull())
    return df.select("path", "line", F.col("text").alias("event"))


def id_map(files: DataFrame, key: str = "question_id") -> DataFrame:
    """Records of JSON files that map an id to a record, or list records: (id, record); of repeated ids the last holds."""
    mapped = files.filter(F.trim("content").startswith("{")).select(F.explode(F.map_entries(F.from_json("content", "map<string,string>"))).alias("e")).select(F.coalesce(F.get_json_object("e.value", f"$.{key}"), F.col("e.key")).alias("id"), F.col("e.value").alias("record"), F.lit(0).alias("place"))
    listed = files.filter(F.trim("content").startswith("[")).select(F.posexplode(F.from_json("content", "array<string>")).alias("place", "record")).select(F.get_json_object("record", f"$.{key}").alias("id"), "record", "place")
    return mapped.unionByName(listed).groupBy("id").agg(F.max_by("record", "place").alias("record"))


def canonical_csv(spark: SparkSession, path: str, wanted: Sequence[str] = ()) -> DataFrame:
    """CSV as text columns with canonical names; raises if wanted columns are missing."""
    df = spark.read.option("header", "true").csv(path)
    df = df.toDF(*(re.sub(r"[^a-z0-9_]", "", re.sub(r"[\s-]+", "_", c.strip().lower())) for c in df.columns))
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve(names: Sequence[str], wanted: str, text_family: Sequence[str] = (".txt", ".md", ".json", ".csv")) -> str | None:
    """The name itself, else one with the same normalized stem and extension, else with a text extension."""
    norm = lambda n: re.sub(r"[^a-z0-9]", "", n.rpartition(".")[0].lower())
    ext = lambda n: "." + n.rpartition(".")[2].lower()
    tiers = (lambda n: n == wanted, lambda n: norm(n) == norm(wanted) and ext(n) == ext(wanted), lambda n: norm(n) == norm(wanted) and ext(n) in text_family and ext(wanted) in text_family)
    return next((n for tier in tiers for n in sorted(names) if tier(n)), None)


def resolved(wanted: DataFrame, files: DataFrame, by: Sequence[str] = (), text_family: Sequence[str] = (".txt", ".md", ".json", ".csv")) -> DataFrame:
    """`resolve` for tables: (by, wanted, name) of each distinct wanted name, with the file of its folder (the columns `by`) that
    it means, null without one. Each name is a key of up to three tiers, so tiers are one equality join; of several files
    in the best tier the least name holds. A name without a dot has an empty stem. Null names mean nothing."""

    def keyed(df: DataFrame, column: str) -> DataFrame:
        c = F.col(column)
        stem = F.regexp_replace(F.lower(F.regexp_extract(c, r"(?s)^(.*)\.", 1)), "[^a-z0-9]", "")
        ext = F.concat(F.lit("."), F.lower(F.substring_index(c, ".", -1)))
        tiers = F.array(F.struct(F.lit(0).alias("tier"), c.alias("key")), F.struct(F.lit(1).alias("tier"), F.concat(stem, ext).alias("key")), F.struct(F.lit(2).alias("tier"), F.when(ext.isin(*text_family), stem).alias("key")))
        return df.select(*by, column, F.inline(tiers)).filter("tier = 0 or key is not null")  # else names without a family meet in one task

    known = keyed(files, "name").groupBy(*by, "tier", "key").agg(F.min("name").alias("name"))
    met = keyed(wanted, "wanted").join(known, [*by, "tier", "key"], "left")
    best = F.min(F.when(F.col("name").isNotNull(), F.struct("tier", "name")))
    return met.groupBy(*by, "wanted").agg(best.alias("best")).select(*by, "wanted", F.col("best.name").alias("name"))


def artifacts(files: DataFrame, least: int = 3) -> DataFrame:
    """path, filled (at least so many bytes), parses (content is JSON)."""
    return files.select("path", (F.col("length") >= least).alias("filled"), F.try_parse_json("content").isNotNull().alias("parses"))


def grades(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Each expected task with its grade file's pass, score (or score so far) and status; without a readable file all are null."""
    c = F.col("content")
    task = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    good = files.filter(F.try_parse_json("content").isNotNull())
    read = good.select(task.alias("task"), F.get_json_object(c, "$.pass").cast("boolean").alias("passed"), F.coalesce(F.get_json_object(c, "$.score"), F.get_json_object(c, "$.score_so_far")).try_cast("double").alias("score"), F.coalesce(F.get_json_object(c, "$.status"), F.lit("ok")).alias("status"))
    return expected.join(read, "task", "left")


def newest(folders: DataFrame, key: str, path: str, modified: str) -> DataFrame:
    return folders.groupBy(key).agg(F.max_by(path, F.struct(modified, path)).alias(path))


def prometheus(text: DataFrame, column: str = "value", ranks: Sequence[str] = ("tp_rank", "pp_rank")) -> DataFrame:
    """(metric, labels, value) of exposition lines; lines of a rank other than 0 are left out."""
    c = F.col(column)
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})?\s+([-+0-9.eE]+|NaN|[-+]?Inf)"
    labels = F.map_from_arrays(F.regexp_extract_all(F.regexp_extract(c, pattern, 2), F.lit(r'([A-Za-z_]\w*)="([^"]*)"'), 1), F.regexp_extract_all(F.regexp_extract(c, pattern, 2), F.lit(r'([A-Za-z_]\w*)="([^"]*)"'), 2))
    out = text.filter(c.rlike(pattern)).select(F.regexp_extract(c, pattern, 1).alias("metric"), labels.alias("labels"), F.regexp_extract(c, pattern, 3).try_cast("double").alias("value"))
    for r in ranks:
        out = out.filter(F.coalesce(F.col("labels")[r], F.lit("0")) == "0")
    return out


def subtitles(files: DataFrame) -> DataFrame:
    """(path, place, start, end, text) of SRT blocks; blocks without a time line are skipped."""
    from millrace.functions.text import clock_seconds

    time = r"([0-9:,.]+)\s*-->\s*([0-9:,.]+)"
    blocks = files.select("path", F.posexplode(F.split(F.trim(F.replace("content", F.lit("\r"), F.lit(""))), r"\n\s*\n")).alias("place", "block"))
    body = F.trim(F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1), r"\s*\n\s*", " "))
    return blocks.filter(F.col("block").rlike(time)).select("path", "place", clock_seconds(F.regexp_extract("block", time, 1)).alias("start"), clock_seconds(F.regexp_extract("block", time, 2)).alias("end"), body.alias("text"))


def normalized_results(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, unreadable files) of result files: a list, or an object with `results`."""
    ok = F.trim("content").startswith("[") | F.coalesce(F.trim(F.get_json_object("content", "$.results")).startswith("["), F.lit(False))
    good = F.coalesce(ok & F.try_parse_json("content").isNotNull(), F.lit(False))
    return json_items(files.filter(good), ("results",), strict=False), files.filter(~good).select("path")


def typed(items: DataFrame, schema: str | T.StructType, column: str = "item") -> DataFrame:
    return items.withColumn("row", F.from_json(column, schema)).select("*", "row.*").drop("row", column)


def path_key(path: Column, names: Sequence[str]) -> Column:
    from millrace.functions.text import benchmark_of

    return benchmark_of(path, names)
