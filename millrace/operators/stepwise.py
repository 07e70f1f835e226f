"""What operators that go on until nothing changes need: tables that cut lineage, and connected components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines see; a folder of our own only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (found or f"/tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


class Steps:
    """Tables of one run of an operator, written once, so that a lost executor repeats no earlier step."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, component): the least node that each node of an edge (a, b) reaches, that node itself included.

    Nodes are of any type with an order. Large and small stars in turn: each round ties a node's neighbours to the least
    of them, by partial minima and joins, so no node's neighbours are ever gathered.
    """
    ends = F.array_sort(F.array("a", "b"))
    now = steps.put(edges.filter("a <> b").select(F.element_at(ends, 2).alias("a"), F.element_at(ends, 1).alias("b")).distinct(), "edges-0")
    seen, k = None, 0
    while (found := tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())) != seen and found[0]:
        seen, k = found, k + 1
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = steps.put(moved.filter("a <> b").distinct(), f"edges-{k}")
        steps.drop(f"edges-{k - 1}")
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(tops)
