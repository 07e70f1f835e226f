"""Writers. Spark's commit makes each of them all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompts(records: DataFrame, path: str) -> None:
    """prompt, label and metadata, all text, as Parquet with snappy. Records: id, question, answer_type, ground_truth, options, source."""
    prompt_rows(records).write.mode("overwrite").option("compression", "snappy").parquet(path)


def prompt_rows(records: DataFrame) -> DataFrame:
    from millrace.functions.text import prompt

    task = F.concat_ws(":", F.coalesce("source", F.lit("fixture")), F.col("id").cast("string"))
    return records.select(prompt(F.col("question"), F.col("options")).alias("prompt"), F.to_json("ground_truth").alias("label"), F.to_json(F.struct(task.alias("task_id"), "answer_type")).alias("metadata"))


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def with_digest(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256))


def decoded(df: DataFrame, column: str) -> DataFrame:
    """Base64 image payloads (with or without a data header) as bytes; null if they are not base64."""
    return df.withColumn("bytes", F.try_to_binary(F.regexp_replace(column, r"^data:[^,]*,", ""), F.lit("base64")))


def dataset(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Writes rows as JSON lines in order of the key, and returns a one-row manifest: rows and a digest of row digests."""
    from millrace.operators.quality import set_digest

    rows.orderBy(key).write.mode("overwrite").json(path)
    return with_digest(rows, *rows.columns).agg(F.count("*").alias("rows"), set_digest(F.col("sha256")).alias("sha256"))
