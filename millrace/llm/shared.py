"""Tables that cut lineage, a size-bounded Bloom filter, and reading of the inputs."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and the five control characters that follow.
WORD = r"[^\x20\x09-\x0D]+"
_SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
ROW_GROUP = 16 << 20  # bytes that a writer holds before it writes them out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (found or f"/tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


class _SmallBatches:
    """While a session writes tables, Arrow batches of few rows: whole documents make large ones, which both sides keep in memory. The setting comes back when the last of them is written."""

    lock = threading.Lock()
    writing: ClassVar[dict[int, list]] = {}

    def __init__(self, spark: SparkSession):
        self.conf, self.key = spark.conf, id(spark)

    def __enter__(self) -> None:
        with self.lock:
            held = self.writing.setdefault(self.key, [0, {k: self.conf.get(k) for k in _SMALL}])
            held[0] += 1
            for k, v in _SMALL.items():
                self.conf.set(k, v)

    def __exit__(self, *_) -> None:
        with self.lock:
            held = self.writing[self.key]
            held[0] -= 1
            if not held[0]:
                for k, v in self.writing.pop(self.key)[1].items():
                    self.conf.set(k, v)


class Scratch:
    """Parquet tables in the shared folder. Written once, so a lost executor costs no recomputation of what led to them."""

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with _SmallBatches(self.spark):
            df.write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)

    @classmethod
    def release(cls, since: int) -> None:
        """Deletes all tables of operators that began after the first `since` did, once their results are written elsewhere."""
        for s in cls.made[since:]:
            s.drop("")
        del cls.made[since:]


def _counted(name: str):
    """Rows of a sorted partition with its number and their running number in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = pa.array(np.arange(n + 1, n + 1 + batch.num_rows))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), at], [*batch.schema.names, "_part", name])

    return run


def ordinal(rows: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """Rows with their place (from 1) in a total order of all rows, without one task that sees all: ranges are sorted and numbered each on its own, written, and the rows of the ranges before are added. A number for each range comes together."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    put = scratch.put(sorted_rows.mapInArrow(_counted(name), f"{kinds}, _part int, `{name}` long"), f"ranges-{name}")
    sizes = put.groupBy("_part").agg(F.max(name).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return put.join(before, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def crc_mod(column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


BLOOM_WORDS = 1 << 18  # 64-bit words at most: what the filter takes on a worker is bounded, whatever the number of keys


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with `maybe`: false only where no row of keys has this value of the column; an exact join follows every use.

    A Bloom filter of two bits in one word for each key, as a broadcast table of words, 12 bits for each key up to
    BLOOM_WORDS words. With so many keys that it would let most through, all rows are marked and none is looked up.
    """
    n = keys.count()
    if n > 12 * BLOOM_WORDS:
        return rows.withColumn("maybe", F.lit(True))
    words = min(BLOOM_WORDS, 1 << max(6, (12 * n // 64).bit_length()))

    def place(h: Column) -> tuple[Column, Column]:
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int"))
        return F.pmod(h, F.lit(words)).cast("int"), bit(40).bitwiseOR(bit(50))

    at, mask = place(F.xxhash64(F.col(key)))
    table = keys.select(at.alias("bloom_at"), mask.alias("mask")).groupBy("bloom_at").agg(F.bit_or("mask").alias("bloom_bits"))
    found = rows.withColumn("bloom_at", at).join(F.broadcast(table), "bloom_at", "left")
    return found.withColumn("maybe", F.coalesce(F.col("bloom_bits").bitwiseAND(mask) == mask, F.lit(False))).drop("bloom_at", "bloom_bits")
