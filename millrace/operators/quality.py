"""Checks that report offenders or one verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.nested import flattened
from millrace.functions.text import SECRET, SECRET_NAME


def vocabulary_share(df: DataFrame, column: str, allowed: DataFrame, value: str) -> DataFrame:
    """Rows, rows whose value is in the vocabulary, and their share (1 without rows)."""
    known = allowed.select(F.col(value).alias("_v")).distinct()
    met = df.join(known, F.col(column) == F.col("_v"), "left")
    return met.agg(F.count("*").alias("rows"), F.count("_v").alias("known"), F.coalesce(F.try_divide(F.count("_v").cast("double"), F.count("*")), F.lit(1.0)).alias("ratio"))


def offenders(df: DataFrame, column: str, allowed: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(column).distinct().join(allowed.select(F.col(value).alias(column)), column, "left_anti")


def secrets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a credential or a private path in any of the texts, and in which."""
    hits = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string").rlike(SECRET), F.lit(False)), F.lit(c)) for c in columns)))
    return df.withColumn("leaks", hits).filter(F.size("leaks") > 0)


def nested_secrets(df: DataFrame, column: str, deepest: int | None = None) -> DataFrame:
    """Where a nested JSON text holds a name like that of a credential, at any level, or a value that is one or a private path: a row for each innermost value, with its path and why."""
    named = F.exists("names", lambda n: n.rlike(SECRET_NAME))
    why = F.when(named, "name").when(F.col("value").rlike(SECRET), "value")
    return flattened(df, column, deepest).withColumn("why", why).filter("why is not null").drop("names", "value")


def unique_ids(df: DataFrame, column: str) -> DataFrame:
    n, d = F.count("*"), F.count_distinct(column)
    return df.agg(n.alias("rows"), d.alias("ids"), ((n == d) & (F.count(column) == n)).alias("unique"))


def same_sets(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    x, y = a.select(*columns).distinct(), b.select(*columns).distinct()
    out = x.exceptAll(y).agg(F.count("*").alias("missing")).join(y.exceptAll(x).agg(F.count("*").alias("extra")))
    return out.withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


def schema_difference(found: Sequence[str], wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns that are missing and that are unexpected."""
    return [c for c in wanted if c not in found], [c for c in found if c not in wanted]


def crowded_groups(df: DataFrame, group: str, most: int = 1) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > most)


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"))


def bounds(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).between(low, high), F.lit(False)))


def one_value(df: DataFrame, key: Sequence[str], value: Column) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(*key).agg(F.count_distinct(value).alias("values")).filter("values > 1")


def repeated_without(df: DataFrame, other: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Keys with at least so many rows of which the other side has none."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least).join(other, key, "left_anti")


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules they break."""
    return df.withColumn("broken", F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))))


def set_digest(c: Column) -> Column:
    """Of a set of values, whatever their order: the number of them and the sums, modulo 2 to the 64, of four parts of their digests. An aggregate of fixed size."""
    h = F.sha2(c.cast("string").cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return F.sha2(F.concat_ws("-", F.count(c).cast("string"), *parts).cast("binary"), 256)


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Whether no key is on both sides."""
    return a.join(b, key, "left_semi").agg((F.count("*") == 0).alias("disjoint"))
