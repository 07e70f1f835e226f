"""Structured Streaming forms of the batch operators: running reports, coalesced batches, resume, state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def running_report(rows: DataFrame, key: str, verdict: str) -> DataFrame:
    """Counts and accuracy by key; written in complete mode, it is the drain that rewrites its report after each batch."""
    return rows.groupBy(key).agg(F.count("*").alias("count"), F.count_if(F.col(verdict)).alias("correct"), F.coalesce(F.try_divide(F.count_if(F.col(verdict)).cast("double"), F.count(verdict)), F.lit(0.0)).alias("accuracy"))


def to_memory(df: DataFrame, name: str, mode: str) -> StreamingQuery:
    """Runs over what is there and ends; the result is a table of that name."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()


def coalesced(requests: DataFrame, wait_ms: int, checkpoint: str, fire: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Fires for what came within the wait; the source's files per trigger bound a batch."""
    return requests.writeStream.foreachBatch(fire).option("checkpointLocation", checkpoint).trigger(processingTime=f"{wait_ms} milliseconds").start()


def batches_of(rows: DataFrame, size: int, ordinal: str, arrived: str, wait: int) -> DataFrame:
    """The batch that each request falls in, as the coalescer would cut a recorded log: at `size` requests, or at the first that arrives `wait` after the batch's first. Sequential by nature, so it runs by key of the log."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([arrived, ordinal], kind="stable")
        batch, count, began, out = -1, size, 0, []
        for t in pdf[arrived]:
            if count >= size or t - began >= wait:
                batch, count, began = batch + 1, 0, t
            count += 1
            out.append(batch)
        return pdf.assign(batch=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch long"
    return rows.groupBy("log").applyInPandas(cut, schema)


def distinct_calls(events: DataFrame, time: str, key: str, delay: str) -> DataFrame:
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, key: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width, slide), key).agg(F.count("*").alias("n"))


def upserted(rows: DataFrame, store: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest row of each key as a new version of a Parquet table; a restarted query repeats no batch's effect."""

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{epoch - 1}")
        had = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        both = spark.read.parquet(f"{store}/{epoch - 1}").unionByName(batch) if had else batch
        fields = [c for c in both.columns if c != key]
        both.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(order)).alias("r")).select(key, "r.*").write.mode("overwrite").parquet(f"{store}/{epoch}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_version(spark: SparkSession, store: str) -> DataFrame:
    """The table as the last batch has left it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(store)
    names = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    return spark.read.parquet(f"{store}/{max(int(n) for n in names if n.isdigit())}")


def hysteresis(readings: DataFrame, key: str, value: str, high: float, low: float, idle: int | None = 3_600_000) -> DataFrame:
    """key, readings so far, paused: a switch that goes on at `high` and off below `low`; state is one flag and a count, and ends `idle` milliseconds after the last reading. None, for records that end: it stays, for a query that waits for the clock never has all that there is."""

    def step(k: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        on, n = state.get if state.exists else (False, 0)
        for v in pd.concat(list(parts)).sort_values("ordinal")[value]:
            on, n = (True if v >= high else False if v < low else on), n + 1
        state.update((bool(on), int(n)))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({key: [k[0]], "readings": [n], "paused": [bool(on)]})

    return readings.groupBy(key).applyInPandasWithState(step, f"{key} string, readings long, paused boolean", "paused boolean, n long", "update", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
