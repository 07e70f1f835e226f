"""What queries share: the registry, and the test tables with exact time and money columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With sec (seconds since 1970, whatever the session's zone) and cents (whole hundredths of the value)."""
    sec = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", sec.alias("sec"), F.floor(F.col("value") * 100).cast("long").alias("cents"))


#: The same in SQL.
EV = "ev AS (SELECT event_id, user_id, event_type, value, props, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec, CAST(floor(value * 100) AS BIGINT) AS cents FROM events)"
