"""Recorded tables as streams: rows become files in the order of a column, a stream reads them, runs to its end, and its results are a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators.stepwise import Steps
from millrace.streaming.stateful import STORE

_PENDING: dict[str, list[Callable[[], None]]] = {}  # parts of a replay that are still to be written


def replayed(rows: DataFrame, order: str, epochs: int, steps: Steps, last: list[Column] | None = None) -> DataFrame:
    """A stream of the rows in `epochs` parts by a numeric column, whose bounds are approximate quantiles. Equal values are in one part, and a part is a trigger, so none of its rows is late for another. `last`, one row that comes after all others, lets timers and watermarks of a finished record run out."""
    spark = rows.sparkSession
    rows = steps.put(rows, "recorded")
    cuts = sorted(set(rows.approxQuantile(order, [k / epochs for k in range(1, epochs)], 0.01))) if epochs > 1 else []
    part = F.lit(0)
    for c in cuts:
        part = part + (F.coalesce(F.col(order), F.lit(c)) >= c).cast("int")
    parts = [rows.filter(part == k) for k in range(len(cuts) + 1)] + ([spark.range(1).select(*last)] if last is not None else [])
    _PENDING[steps.root] = [lambda df=df, k=k: df.write.parquet(f"{steps.root}/in/part={k}") for k, df in enumerate(parts)]
    _PENDING[steps.root].pop(0)()  # the folder must be there
    return spark.readStream.schema(rows.schema).parquet(f"{steps.root}/in/*")


def _run(start: Callable[[], StreamingQuery], steps: Steps) -> None:
    """Starts a query that takes what is there, waits for its end, and again after each part that is still to come; its checkpoint goes on."""
    spark, rest = steps.spark, _PENDING.pop(steps.root, [])
    for write in [None, *rest]:
        if write:
            write()
        had = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
        try:
            q = start()
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", had)
        q.awaitTermination()


def finished(stream: DataFrame, mode: str, steps: Steps) -> DataFrame:
    """What a stream has written when all parts are read: all rows (append, or with their epoch, update), or those of its last version (complete). Each epoch is a folder of its own, so one that runs again writes the same."""
    spark = stream.sparkSession

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{steps.root}/out/epoch={epoch}")

    _run(lambda: stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{steps.root}/checkpoint").trigger(availableNow=True).start(), steps)
    out = spark.read.schema(stream.schema.add("epoch", "long")).option("basePath", f"{steps.root}/out").parquet(f"{steps.root}/out")
    if mode == "complete":
        out = out.filter(F.col("epoch") == out.agg(F.max("epoch")).first()[0])
    return out if mode == "update" else out.drop("epoch")


def latest(updates: DataFrame, key: str) -> DataFrame:
    """Of the updates of each key the last."""
    fields = [c for c in updates.columns if c not in (key, "epoch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*fields), "epoch").alias("r")).select(key, "r.*")


def ran(start: Callable[[DataFrame], StreamingQuery], stream: DataFrame, steps: Steps) -> None:
    """Runs a query that writes for itself over all parts."""
    _run(lambda: start(stream), steps)
