"""Interval and sequence operators. Intervals are half open: [start, end)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, key: Sequence[str], start: str, end: str, drop_empty: bool = True) -> DataFrame:
    """Islands of overlapping or touching intervals of a key: key, start, end, n. With drop_empty those with start >= end go first."""
    if drop_empty:
        df = df.filter(F.col(start) < F.col(end))
    w = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col(start) > before)).cast("int")
    df = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return df.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def overlap_pairs(left: DataFrame, right: DataFrame, key: Sequence[str], width: Column | int, names: tuple[str, str, str, str] = ("s", "e", "s2", "e2")) -> DataFrame:
    """Pairs of a key whose intervals overlap. Both sides go to the buckets of a fixed width that they touch, meet by equality there, and a pair counts in the bucket in which its overlap begins; so a key with many intervals is many small buckets."""
    s, e, s2, e2 = names
    w = F.lit(width) if isinstance(width, int) else width
    floor = lambda c: F.floor(F.col(c) / w)
    a = left.filter(F.col(s) < F.col(e)).withColumn("_bucket", F.explode(F.sequence(floor(s), F.floor((F.col(e) - 1) / w) if isinstance(width, int) else floor(e))))
    b = right.filter(F.col(s2) < F.col(e2)).withColumn("_bucket", F.explode(F.sequence(floor(s2), F.floor((F.col(e2) - 1) / w) if isinstance(width, int) else floor(e2))))
    met = a.join(b, [*key, "_bucket"]).filter((F.col(s) < F.col(e2)) & (F.col(s2) < F.col(e)))
    return met.filter(F.floor(F.greatest(s, s2) / w) == F.col("_bucket")).drop("_bucket")


def temporal_iou(gold: DataFrame, found: DataFrame, key: Sequence[str], start: str = "s", end: str = "e", width: int = 3600) -> DataFrame:
    """key, common, gold_length, found_length, tiou of the merged intervals of both; keys of gold only. 0 if either has none."""
    g, f = merge(gold, key, start, end), merge(found, key, start, end)
    length = lambda df, name: df.groupBy(*key).agg(F.sum(F.col(end) - F.col(start)).alias(name))
    f2 = f.select(*key, F.col(start).alias("s2"), F.col(end).alias("e2"))
    g2 = g.select(*key, F.col(start).alias("s"), F.col(end).alias("e"))
    common = overlap_pairs(g2, f2, key, width).groupBy(*key).agg(F.sum(F.least("e", "e2") - F.greatest("s", "s2")).alias("common"))
    out = length(g, "gold_length").join(length(f, "found_length"), list(key), "left").join(common, list(key), "left")
    out = out.fillna(0, ["found_length", "common"])
    union = F.col("gold_length") + F.col("found_length") - F.col("common")
    return out.withColumn("tiou", F.coalesce(F.try_divide(F.col("common").cast("double"), union), F.lit(0.0)))


def max_concurrent(df: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """Most intervals open at once, by key; at one time starts come before ends."""
    steps = df.select(*key, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("x")).select(*key, "x.*")
    steps = steps.groupBy(*key, "t", "d").agg(F.sum("d").alias("d_sum"))
    now = F.sum("d_sum").over(Window.partitionBy(*key).orderBy("t", F.desc("d")).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("open", now).groupBy(*key).agg(F.max("open").alias("most_open"))


def violations(df: DataFrame, key: Sequence[str], order: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows that begin before an earlier one of the key ends (a running maximum, not only the row before)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("ended", F.max(end).over(w)).filter(F.col(start) < F.col("ended"))


def differences(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """First and second differences to the rows before."""
    w = Window.partitionBy(*key).orderBy(*order)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return df.withColumn("diff1", F.col(value) - one).withColumn("diff2", F.col(value) - 2 * one + two)


def interpolate(samples: DataFrame, wanted: DataFrame, key: Sequence[str], t: str, v: str) -> DataFrame:
    """Values at wanted times, linear between the samples around and constant beyond the ends. One union, two windows."""
    both = samples.select(*key, t, v, F.lit(0).alias("_ask")).unionByName(wanted.select(*key, t, F.lit(None).cast("double").alias(v), F.lit(1).alias("_ask")))
    w = Window.partitionBy(*key).orderBy(t, "_ask")
    point = F.when(F.col("_ask") == 0, F.struct(F.col(t).alias("t"), F.col(v).alias("v")))
    before = F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = both.withColumn("_b", before).withColumn("_a", after).filter("_ask = 1")
    share = F.try_divide((F.col(t) - F.col("_b.t")).cast("double"), (F.col("_a.t") - F.col("_b.t")).cast("double"))
    value = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull() | (F.col("_b.t") == F.col(t)), F.col("_b.v")).otherwise(F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * share)
    return got.select(*key, t, value.alias("interpolated"))


def tolerant_iou(truth: DataFrame, found: DataFrame, key: Sequence[str], tolerance: int, width: int = 3600) -> DataFrame:
    """Common length with truth widened by a tolerance on both sides, over the union without it, at most 1."""
    wide = truth.withColumn("s", F.col("s") - tolerance).withColumn("e", F.col("e") + tolerance)
    plain = temporal_iou(truth, found, key, width=width).select(*key, (F.col("gold_length") + F.col("found_length") - F.col("common")).alias("_union"))
    common = temporal_iou(wide, found, key, width=width).select(*key, F.col("common").alias("wide_common"))
    return plain.join(common, list(key)).select(*key, "wide_common", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("wide_common").cast("double"), F.col("_union")), F.lit(0.0))).alias("tolerant_iou"))


def clipped_iou(truth: DataFrame, found: DataFrame, key: Sequence[str], tolerance: int, width: int = 3600) -> DataFrame:
    """Of each true interval (key, _id, s, e) its IoU with all found ones of its key together: the common length with the true one widened on both sides, no more than what was found or the widened length, over the union with the plain one. 0 for a union without length. True intervals of keys that found nothing are left out."""
    merged_ = merge(found.select(*key, F.col("s").alias("s2"), F.col("e").alias("e2")), key, "s2", "e2")
    total = merged_.groupBy(*key).agg(F.sum(F.col("e2") - F.col("s2")).alias("_found"))
    wide = truth.select(*key, "_id", F.col("s").alias("s0"), F.col("e").alias("e0"), (F.col("s") - tolerance).alias("s"), (F.col("e") + tolerance).alias("e"))
    met = overlap_pairs(wide, merged_, key, width)
    both = lambda s, e: F.sum(F.greatest(F.lit(0), F.least(e, "e2") - F.greatest(s, "s2")))
    common = met.groupBy("_id").agg(both("s", "e").alias("_wide"), both("s0", "e0").alias("_common"))
    out = wide.join(total, list(key)).join(common, "_id", "left").fillna(0, ["_wide", "_common"])
    union = F.col("_found") + F.col("e0") - F.col("s0") - F.col("_common")
    clipped = F.least("_wide", "_found", F.col("e") - F.col("s"))
    return out.select(*key, "_id", F.when(union <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), clipped / union))).alias("clipped_iou"))


def around(df: DataFrame, key: Sequence[str], t: str, v: str, at: str) -> DataFrame:
    """Greatest value before, and least value from a key's own time on."""
    return df.groupBy(*key).agg(F.max(F.when(F.col(t) < F.col(at), F.col(v))).alias("max_before"), F.min(F.when(F.col(t) >= F.col(at), F.col(v))).alias("min_after"))


def hysteresis(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, high: float, low: float) -> DataFrame:
    """State of a switch that goes on at `high` and off below `low`, and stays between: the last value outside the band decides."""
    mark = F.when(F.col(value) >= high, True).when(F.col(value) < low, False)
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("paused", F.coalesce(F.last(mark, True).over(w), F.lit(False)))
